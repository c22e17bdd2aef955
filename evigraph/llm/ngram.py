"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by the scorers.

Training is three rounds. (1) Tasks deduplicate the word hashes of a few million tokens at a time and hand on sorted blobs by
hash range; a range's merged words are written as one sorted array, and a word's number is its place in the ranges put end to
end. (2) Tasks do the same for pairs of word numbers, dealt by the first word's range; a range with more than its share of the
tokens (a very frequent word) is split by the second word. (3) The numbers of distinct predecessors are summed by word range.
Only sizes and counts of counts, a row a range, reach the driver. Scorers map the files and look up a chunk's pairs in order.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import map_file, put_file, starts_of, table_at, utf8_of, words_hashed, workdir

#: The hash that stands for the end of a text.
END = np.uint64(0xE17A1B2C3D4E5F60)
#: Tokens that a task collects before it hands on a blob, and text bytes scored at a time.
FLUSH, CHUNK = 3_000_000, 4 << 20
BLOB = "bucket int, keys binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64 bits each hash falls in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with END after each text, and tokens per text."""
    n = counts + 1
    stop = np.cumsum(n) - 1
    out = np.empty(int(n.sum()), np.uint64)
    word = np.ones(len(out), bool)
    word[stop] = False
    out[word], out[stop] = hashes, END
    return out, n


def _blobs(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, n: int):
    """A record batch with a row for each bucket that has keys; bucket must be that of each key.

    Counts in blobs are of a flush's tokens or of distinct words, both under 2**32; merged counts have 64 bits.
    """
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.uint32)
    at = np.searchsorted(bucket[order], np.arange(n + 1))
    full = [b for b in range(n) if at[b + 1] > at[b]]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([keys[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([counts[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())],
        names=["bucket", "keys", "counts"],
    )


def _gathered(batches, tokens_of):
    """Concatenated arrays of tokens_of(data, offsets) over batches, a few million at a time."""
    held, size = [], 0
    for batch in batches:
        data, offsets = utf8_of(batch.column(0))
        a = 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
            got = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            held.append(got)
            size += len(got)
            a = b
            if size >= FLUSH:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def _merged(table, kind) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x, kind) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    return summed(keys, counts)


class Model:
    """The files of a trained model, opened in a worker."""

    def __init__(self, where: str, about: dict):
        self.where, self.about, self.files = where, about, {}
        self.first = starts_of(np.array(about["words"], np.int64))
        self.size, self.ranges = int(self.first[-1]), len(about["words"])
        self.parts = np.array(about["parts"], np.int64)
        self.part0 = starts_of(self.parts)

    def file(self, name: str, kind) -> np.ndarray:
        if name not in self.files:
            self.files[name] = map_file(f"{self.where}/{name}", kind)
        return self.files[name]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, which must be sorted; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(bucket_of(hashes, self.ranges), np.arange(self.ranges + 1))
        for b in np.flatnonzero(np.diff(at)):
            if self.first[b + 1] > self.first[b]:
                keys, want = self.file(f"words/{b}.keys", np.uint64), hashes[at[b] : at[b + 1]]
                k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[k] == want
                out[at[b] : at[b + 1]][hit] = self.first[b] + k[hit]
        return out

    def word_values(self, name: str, ids: np.ndarray) -> np.ndarray:
        """The number kept for each word id >= 0, 0 for others; ids need no order."""
        out = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        at = np.searchsorted(ids[order], self.first)
        for b in np.flatnonzero(np.diff(at)):
            rows = order[at[b] : at[b + 1]]
            out[rows] = self.file(f"words/{b}.{name}", np.uint64)[ids[rows] - self.first[b]]
        return out

    def pair_bucket(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The bucket of each pair of word ids; the start of a text, id ``size``, goes with the last range."""
        r = np.minimum(np.searchsorted(self.first, u, side="right") - 1, self.ranges - 1)
        return self.part0[r] + v * self.parts[r] // max(1, self.size)

    def pair_counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(u), np.int64)
        keys = u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)
        bucket = self.pair_bucket(u, v)
        order = np.lexsort((keys, bucket))
        at = np.searchsorted(bucket[order], np.arange(self.part0[-1] + 1))
        for b in np.flatnonzero(np.diff(at)):
            have = self.file(f"pairs/{b}.keys", np.uint64) if self.about["pairs"][b] else ()
            if len(have):
                rows = order[at[b] : at[b + 1]]
                k = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                hit = have[k] == keys[rows]
                c = self.file(f"pairs/{b}.counts", np.uint8)[k].astype(np.int64)
                if (big := np.flatnonzero(c == 255)).size:
                    c[big] = self.file(f"pairs/{b}.more", np.uint64)[np.searchsorted(self.file(f"pairs/{b}.at", np.uint32), k[big])]
                out[rows[hit]] = c[hit]
        return out

    def context(self, u: np.ndarray) -> np.ndarray:
        """(followers, types seen once, twice, more often) of each word id, summed over the parts of its range."""
        out = np.zeros((len(u), 4), np.int64)
        r = np.minimum(np.searchsorted(self.first, u, side="right") - 1, self.ranges - 1)
        order = np.argsort(r, kind="stable")
        at = np.searchsorted(r[order], np.arange(self.ranges + 1))
        for b in np.flatnonzero(np.diff(at)):
            rows = order[at[b] : at[b + 1]]
            for part in range(self.part0[b], self.part0[b + 1]):
                if self.about["pairs"][part]:
                    out[rows] += self.file(f"pairs/{part}.contexts", np.uint64).reshape(-1, 4)[u[rows] - self.first[b]].astype(np.int64)
        return out


@lru_cache(maxsize=2)
def opened(where: str, about: str) -> Model:
    return Model(where, json.loads(about))


def discounts(n: list[int]) -> list[float]:
    """The three discounts from how many items were seen once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def _pieces_of(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum())]


def train(docs: DataFrame, ranges: int | None = None) -> tuple[str, str]:
    """Count and write the model of all texts of ``docs(text)``; returns its folder and what a :class:`Model` needs to know.

    Null texts count as empty: a text with its end only. ``ranges`` defaults to the session's number of shuffle partitions, so
    that what a merging task holds keeps its size when that number follows the input. Counts may be of any size; 2**32 - 1 distinct
    words or more raise ValueError.
    """
    spark = docs.sparkSession
    n = ranges or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    where = workdir(spark, "ngram")
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def hashes(data, offsets):
        return with_ends(*words_hashed(data, offsets))[0]

    def words(batches):
        for got in _gathered(batches, hashes):
            keys, counts = np.unique(got, return_counts=True)
            yield _blobs(keys, counts, bucket_of(keys, n), n)

    def keep_words(key, table):
        import pyarrow as pa

        b = key[0].as_py()
        keys, counts = _merged(table, np.uint64)
        put_file(f"{where}/words/{b}.keys", [keys.tobytes()])
        put_file(f"{where}/words/{b}.counts", [counts.astype(np.uint64).tobytes()])
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    rows = text.mapInArrow(words, BLOB).groupBy("bucket").applyInArrow(keep_words, "bucket int, n long, tokens long").collect()
    sizes, tokens = [0] * n, [0] * n
    for r in rows:
        sizes[r["bucket"]], tokens[r["bucket"]] = r["n"], r["tokens"]
    if sum(sizes) >= 2**32 - 1:
        raise ValueError(f"{sum(sizes)} distinct words: pair keys hold word numbers of 32 bits")
    total = sum(tokens)
    parts = [max(1, round(t * n / max(1, total))) for t in tokens]
    about = {"words": sizes, "parts": parts, "pairs": [0] * sum(parts), "tokens": total}
    shape, buckets = json.dumps(about), sum(parts)

    def pair_keys(data, offsets):
        model = opened(where, shape)
        tokens, n = with_ends(*words_hashed(data, offsets))
        keys, inverse = np.unique(tokens, return_inverse=True)
        v = model.word_ids(keys)[inverse]
        u = np.concatenate([np.zeros(1, np.int64), v[:-1]])
        u[starts_of(n)[:-1]] = model.size
        return u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)

    def pairs(batches):
        for got in _gathered(batches, pair_keys):
            keys, counts = np.unique(got, return_counts=True)
            u, v = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.int64)
            yield _blobs(keys, counts, opened(where, shape).pair_bucket(u, v), buckets)

    def keep_pairs(key, table):
        import pyarrow as pa

        b, model = key[0].as_py(), opened(where, shape)
        keys, counts = _merged(table, np.uint64)
        put_file(f"{where}/pairs/{b}.keys", [keys.tobytes()])
        put_file(f"{where}/pairs/{b}.counts", [np.minimum(counts, 255).astype(np.uint8).tobytes()])
        big = np.flatnonzero(counts >= 255)
        put_file(f"{where}/pairs/{b}.at", [big.astype(np.uint32).tobytes()])
        put_file(f"{where}/pairs/{b}.more", [counts[big].astype(np.uint64).tobytes()])
        r = int(np.searchsorted(model.part0, b, side="right")) - 1
        last = r == model.ranges - 1
        span = int(model.first[r + 1] - model.first[r]) + last
        u = (keys >> np.uint64(32)).astype(np.int64) - int(model.first[r])
        table_of = np.stack([np.bincount(u, w, span) for w in (counts, counts == 1, counts == 2, counts >= 3)], 1).astype(np.uint64)
        put_file(f"{where}/pairs/{b}.contexts", [table_of.tobytes()])
        v, before = np.unique((keys & np.uint64(2**32 - 1)).astype(np.uint32), return_counts=True)
        blobs = _blobs(v, before, np.searchsorted(model.first, v, side="right") - 1, model.ranges)
        out = pa.Table.from_batches([blobs]).append_column("pairs", pa.array([None] * blobs.num_rows, pa.int64())).append_column("stats", pa.array([None] * blobs.num_rows, pa.list_(pa.int64())))
        return pa.concat_tables([out, pa.table({"bucket": pa.array([b], pa.int32()), "keys": pa.array([None], pa.binary()), "counts": pa.array([None], pa.binary()), "pairs": pa.array([len(keys)], pa.int64()), "stats": pa.array([_pieces_of(counts)], pa.list_(pa.int64()))})])

    kept = table_at(text.mapInArrow(pairs, BLOB).groupBy("bucket").applyInArrow(keep_pairs, BLOB + ", pairs long, stats array<long>"), f"{where}/kept")
    high = [0] * 5
    for r in kept.where("pairs is not null").select("bucket", "pairs", "stats").collect():
        about["pairs"][r["bucket"]] = r["pairs"]
        high = [x + y for x, y in zip(high, r["stats"], strict=True)]

    def keep_before(key, table):
        import pyarrow as pa

        b, model = key[0].as_py(), opened(where, shape)
        v, counts = _merged(table, np.uint32)
        out = np.zeros(int(model.first[b + 1] - model.first[b]), np.uint64)
        out[v.astype(np.int64) - int(model.first[b])] = counts
        put_file(f"{where}/words/{b}.before", [out.tobytes()])
        return pa.table({"bucket": pa.array([b], pa.int32()), "total": pa.array([int(counts.sum())], pa.int64()), "stats": pa.array([_pieces_of(counts)], pa.list_(pa.int64()))})

    low, pair_total = [0] * 5, 0
    for r in kept.where("pairs is null").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(keep_before, "bucket int, total long, stats array<long>").collect():
        low = [x + y for x, y in zip(low, r["stats"], strict=True)]
        pair_total += r["total"]
    about |= {"high": discounts(high[:4]), "low": discounts(low[:4]), "low_counts": [low[0], low[1], low[4]], "pair_types": pair_total}
    return where, json.dumps(about)


def chunk_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over each text: tokens, known tokens, base score, model score."""
    about = model.about
    tokens, n = with_ends(*words_hashed(data, offsets))
    keys, inverse = np.unique(tokens, return_inverse=True)
    ids = model.word_ids(keys)
    counts, before = model.word_values("counts", ids), model.word_values("before", ids)
    total, words = about["tokens"], model.size
    base = np.log10((counts + 0.1) / (total + 0.1 * (words + 1)))
    d, types = np.array([0.0, *about["low"]]), max(1, about["pair_types"])
    rest = sum(x * y for x, y in zip(about["low"], about["low_counts"], strict=True)) / types if about["pair_types"] else 1.0
    p1 = np.maximum(before - d[np.minimum(before, 3)], 0) / types + rest / (words + 1)
    v = ids[inverse]
    begin = starts_of(n)
    # of each distinct word as a context, then of each place
    inner = np.flatnonzero(ids >= 0)
    ctx = np.zeros((len(ids) + 1, 4), np.int64)
    ctx[inner] = model.context(ids[inner])
    ctx[-1] = model.context(np.array([words]))[0] if words else 0
    place = np.concatenate([np.zeros(1, np.int64), inverse[:-1]])
    place[begin[:-1]] = len(ids)
    u = np.append(ids, words)[place]
    c = np.zeros(len(v), np.int64)
    both = np.flatnonzero((u >= 0) & (v >= 0))
    c[both] = model.pair_counts(u[both], v[both])
    dh = np.array([0.0, *about["high"]])
    share = np.maximum(ctx[:, 0], 1)
    gamma = np.where(ctx[:, 0] > 0, (ctx[:, 1:] @ dh[1:]) / share, 1.0)
    p = np.maximum(c - dh[np.minimum(c, 3)], 0) / share[place] + gamma[place] * p1[inverse]
    add = np.add.reduceat
    return {"n_tokens": n, "n_known": add((counts > 0)[inverse].astype(np.int64), begin[:-1]), "base_score": add(base[inverse], begin[:-1]), "score": add(np.log10(p), begin[:-1])}


def score(docs: DataFrame, where: str, about: str) -> DataFrame:
    """Score ``docs(doc_id, held_out, text)`` by a trained model: one row for each, log10 probabilities of whole texts.

    A null text is empty and has its end only. Repeated rows, null ids and other columns do no harm; no rows give no rows.
    """
    import pyarrow as pa

    total = json.loads(about)["tokens"]

    def run(batches):
        model = opened(where, about)
        for batch in batches:
            data, offsets = utf8_of(batch.column(2))
            a = 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
                got = chunk_scores(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(b - a, total, np.int64)), pa.array(got["base_score"]), pa.array(got["score"])], names=[x.split()[0] for x in SCORES.split(", ")])
                a = b

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """``scores`` with the perplexity a token by the model and by the base."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumn("base_perplexity", F.pow(F.lit(10.0), -F.col("base_score") / F.col("n_tokens")))


def remainder(column: str, n: int):
    """crc32 of an integer column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % n


def train_and_score(docs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod 10 is not 0 (a null id is one of them), and score all rows."""
    held = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)))
    where, about = train(held.where(~F.col("held_out")))
    return score(held, where, about)
