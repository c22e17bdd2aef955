"""Near-duplicate classes by a multi-index Hamming join over b-bit MinHash signatures, with links confirmed on full shingle sets.

A document's set holds its distinct five-word shingles. Equal sets are one node from the start. A node's signature has chunks
of ``WIDTH`` symbols of 16 bits, as many as the threshold needs (``chunks_of``). By the pigeonhole principle two signatures that
differ in fewer than twice as many symbols as there are chunks agree in some chunk but for one symbol at most, so each node is indexed under every chunk with every one of its symbols left
out: all pairs under that distance meet. Inside an index bucket no pairs are enumerated at first: members are compared with the
bucket's two extreme members, links are confirmed and connected, and only buckets that still hold several components are searched
in blocks for pairs between components; a pair that meets in several buckets is handed on from the first. Of nodes that meet at all a
longer signature (``FINE`` symbols of 8 bits) is kept, which rules out pairs ``FINE_SIGMAS`` deviations under the threshold. Every link is
confirmed by intersecting the whole sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evigraph.llm.common import mix, ragged, starts_of, table_at, tidy, utf8_of, words_hashed, workdir

CHUNKS, WIDTH = 8, 6
SYMBOLS = CHUNKS * WIDTH
#: Chunks at the lowest threshold, and the probability with which a pair at the threshold may miss all indexes.
MOST_CHUNKS, MISS = 12, 7e-6
#: Symbols of the longer signature, and how far under the threshold its estimate may be.
FINE, FINE_SIGMAS = 1024, 4.5
#: Most members of a block in the search between components.
BLOCK = 512
#: Candidate documents up to which their two ids (16 bytes each, so 32 MB) are sent to all tasks; beyond it they are joined by shuffling.
SMALL = 2_000_000
SHINGLE = 5
_SALTS = (0x51ED270B, 0xA54FF53A)
# a stream of its own: workers that import other modules first must draw the same constants
_rng = np.random.default_rng(20240229)
_rng.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_FA = _rng.integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FB = _rng.integers(1, 2**63, FINE, dtype=np.uint64)
_KEY = _rng.integers(1, 2**63, (CHUNKS, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# drawn last, so that the first CHUNKS chunks don't depend on how many may follow
_A = np.concatenate([_A, _rng.integers(1, 2**63, MOST_CHUNKS * WIDTH - SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
_B = np.concatenate([_B, _rng.integers(1, 2**63, MOST_CHUNKS * WIDTH - SYMBOLS, dtype=np.uint64)])
_KEY = np.concatenate([_KEY, _rng.integers(1, 2**63, (MOST_CHUNKS - CHUNKS, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 48-bit shingle hashes of each text, one after the other; how many each has). Up to 65,536 texts.

    A text with fewer than five words has its whole sequence as one shingle; one without words has none.
    """
    words, n = words_hashed(data, offsets)
    begin = starts_of(n)[:-1]
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    at = ragged(begin, size)
    row = np.repeat(np.arange(len(n)), size)
    left = np.minimum(np.repeat(n, size), SHINGLE)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = left > k
        if there.all():
            h += words[at + k] * _PLACE[k]
        else:
            h[there] += words[at[there] + k] * _PLACE[k]
    keys = row.astype(np.uint64) << np.uint64(48) | mix(h + left.astype(np.uint64)) >> np.uint64(16)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]])]
    return keys & np.uint64(2**48 - 1), np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(n))


def signatures_of(sets: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, kind=np.uint16) -> np.ndarray:
    """The symbols (a row for each of the non-empty sets, which stand one after the other)."""
    begin = starts_of(counts)[:-1]
    out = np.empty((len(counts), len(a)), kind)
    for k in range(len(a) if len(counts) else 0):
        out[:, k] = mix(np.minimum.reduceat(sets * a[k] + b[k], begin)).astype(kind)
    return out


def chunks_of(percent: int) -> int:
    """Chunks with which a pair at the threshold shares no index key with a probability of at most ``MISS``."""
    p = percent / 100
    missed = 1 - p**WIDTH - WIDTH * p ** (WIDTH - 1) * (1 - p)
    chunks = next((k for k in range(CHUNKS, MOST_CHUNKS + 1) if missed**k <= MISS), None)
    if chunks is None:
        raise ValueError(f"a threshold of {percent} % needs more than {MOST_CHUNKS} chunks")
    return chunks


def fine_least(percent: int) -> int:
    """Equal symbols of the longer signature under which a pair is ruled out."""
    p = percent / 100
    return int(FINE * p - FINE_SIGMAS * (FINE * p * (1 - p)) ** 0.5)


def first_place(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of signatures the first index place (chunk and symbol left out) that both share; their length without one."""
    same = (x == y).reshape(len(x), y.shape[-1] // WIDTH, WIDTH)
    n = same.sum(2)
    chunk = (n >= WIDTH - 1).argmax(1)
    rows = np.arange(len(same))
    inside = np.where(n[rows, chunk] == WIDTH, 0, same[rows, chunk].argmin(1))
    return np.where(n[rows, chunk] >= WIDTH - 1, chunk * WIDTH + inside, y.shape[-1])


def index_keys(sig: np.ndarray) -> np.ndarray:
    """The index keys of each signature, one for each symbol: each chunk without each of its symbols."""
    symbols = sig.shape[1]
    part = sig.reshape(len(sig), symbols // WIDTH, WIDTH).astype(np.uint64) + np.uint64(1)
    weighed = mix(part * _KEY[: symbols // WIDTH])
    total = weighed.sum(2, keepdims=True, dtype=np.uint64)
    place = np.arange(symbols, dtype=np.uint64).reshape(symbols // WIDTH, WIDTH) * np.uint64(0x9E3779B97F4A7C15)
    return mix((total - weighed) ^ place).reshape(len(sig), symbols)


def _chunks(batch, column: int, most: int = 2 << 20):
    data, offsets = utf8_of(batch.column(column))
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, a + 65_536)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _signed(symbols: int):
    """doc_id, n_shingles, set id, check sum and signature of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, data, offsets in _chunks(batch, 1):
                sets, n = shingle_sets(data, offsets)
                full = np.flatnonzero(n)
                sums = [np.zeros(b - a, np.uint64) for _ in range(2)]
                sigs: list = [None] * (b - a)
                if len(full):
                    begin = starts_of(n[full])[:-1]
                    for s, salt in zip(sums, _SALTS, strict=True):
                        s[full] = mix(np.add.reduceat(mix(sets + np.uint64(salt)), begin) + n[full].astype(np.uint64))
                    for k, sig in zip(full, signatures_of(sets, n[full], _A[:symbols], _B[:symbols]), strict=True):
                        sigs[k] = sig.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "s", "s2", "sig"])

    return run


def _indexed(symbols: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(s), 4096):
                sig = np.frombuffer(b"".join(batch.column(1).slice(a, 4096).to_pylist()), np.uint16).reshape(-1, symbols)
                keys = index_keys(sig)
                place = np.tile(np.arange(symbols, dtype=np.int8), len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(s[a : a + 4096], symbols)), pa.array(place)], names=["key", "s", "place"])

    return run


def _shingled(batches):
    """s, the whole set (bytes of uint64) and the longer signature of each (s, text); s must be the text's own set id.

    A doc_id that stands on several rows may bring texts of other sets: the set's own sum decides.
    """
    import pyarrow as pa

    for batch in batches:
        for a, b, data, offsets in _chunks(batch, 1):
            sets, n = shingle_sets(data, offsets)
            want = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            begin = starts_of(n)
            full = np.flatnonzero(n)
            sums = mix(np.add.reduceat(mix(sets + np.uint64(_SALTS[0])), begin[full]) + n[full].astype(np.uint64)) if len(full) else np.empty(0, np.uint64)
            full = full[sums.view(np.int64) == want[full]]
            size = n[full]
            fine = signatures_of(sets[ragged(begin[full], size)], size, _FA, _FB, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(want[full]), pa.array([sets[begin[k] : begin[k + 1]].tobytes() for k in full], pa.binary()), pa.array([x.tobytes() for x in fine], pa.binary())], names=["s", "items", "fine"])


def _close(least: int):
    """Pairs whose longer signatures allow a link."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("fine_a", "fine_b"))
                keep = pa.array((x == y).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return run


def _confirmed(percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right, ok = batch.column("items_a"), batch.column("items_b"), []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                k = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[k] == y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def _across(least: int, percent: int, symbols: int):
    """Pairs of one block pair whose components differ, whose signatures allow a link and that meet in no earlier bucket."""

    def run(key, table):
        import pyarrow as pa

        s, c, n, block = (table.column(k).to_numpy() for k in ("s", "c", "n", "block"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, symbols)
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        place, i, j = (table.column("place")[0].as_py() if len(s) else 0), key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out_a, out_b = [], []
        for k in left:
            to = right[right > k] if i == j else right
            to = to[(c[to] != c[k]) & (100 * np.minimum(n[to], n[k]) >= percent * np.maximum(n[to], n[k]))]
            to = to[(fine[to] == fine[k]).sum(1) >= least]
            to = to[first_place(sig[to], sig[k]) == place]
            out_a += [min(s[k], x) for x in s[to]]
            out_b += [max(s[k], x) for x in s[to]]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _rooted(batches):
    """The links of a task as one edge from each node to the least node that the task's links connect it with."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    pairs = [(x, y) for x in up if (y := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])


def components(links: DataFrame, where: str) -> DataFrame:
    """(node, c): the least node that each node of ``links(a, b)`` reaches.

    Tasks first replace their links by stars, then large and small stars alternate over all. Each round is written to the shared
    folder, and one row a round comes to the driver. Nodes without links have no row.
    """
    n = links.count()
    edges = table_at(links.select("a", "b").mapInArrow(tidy(_rooted), "u long, v long"), f"{where}/cc0", n)
    before, k = None, 0
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        k += 1
        seen = Observation()
        edges = table_at(small.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")), f"{where}/cc{k}", n)
        now = (seen.get["n"], seen.get["x"])
        if now == before or not now[0]:
            break
        before = now
    # now each node has one edge, to its component's least node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("c")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Link the rows of ``docs(doc_id, text)`` whose shingle sets satisfy 100 * intersection >= percent * union (80 or more).

    Returns for each row doc_id, n_shingles, component_id (the least doc_id reachable) and kept (doc_id = component_id).
    Empty and null texts have no shingles and stand alone. Repeated rows are equal sets and so are linked; rows with a null
    doc_id link with nothing, have a null component_id and are kept. Other columns are ignored; no rows give no rows.
    """
    where, symbols = workdir(docs.sparkSession, "neardup"), chunks_of(percent) * WIDTH
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    signed = table_at(text.mapInArrow(tidy(_signed(symbols)), "doc_id long, n_shingles long, s long, s2 long, sig binary"), f"{where}/signed")
    rows, least = signed.count(), fine_least(percent)
    named = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = named.groupBy("s", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    nodes = table_at(nodes.select("s", F.col("n_shingles").alias("n"), "rep", "sig"), f"{where}/nodes", rows)
    keys = nodes.select("s", "sig").mapInArrow(tidy(_indexed(symbols)), "key long, s long, place byte")
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    members = table_at(keys.join(shared, "key", "left_semi"), f"{where}/members", 4 * rows)
    sets = _candidate_sets(text, nodes, members, where)

    def sides(*columns: str) -> list[DataFrame]:
        return [sets.select(F.col("s").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in ("a", "b")]

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        x, y = sides("items")
        return table_at(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(tidy(_confirmed(percent)), "a long, b long, linked boolean"), f"{where}/{name}").where("linked")

    ends = members.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    stars = members.join(ends, "key").select("s", F.explode(F.array("lo", "hi")).alias("hub")).where("s <> hub")
    stars = stars.select(F.least("s", "hub").alias("a"), F.greatest("s", "hub").alias("b")).distinct()
    x, y = sides("n", "fine")
    fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    stars = table_at(stars.join(x, "a").join(y, "b").where(fit).mapInArrow(tidy(_close(least)), "a long, b long"), f"{where}/stars", rows)
    comp = components(confirmed(stars, "star-links"), f"{where}/step1")
    open_pairs = table_at(_between(members, sets, comp, least, percent, symbols, where), f"{where}/open")
    more = confirmed(open_pairs, "more-links")
    # links between components: only those are connected anew
    a, b = (comp.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in ("a", "b"))
    more = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(more, f"{where}/step2").select(F.col("node").alias("c"), F.col("c").alias("top"))
    inner = comp.join(top, "c", "left").select("node", F.coalesce("top", "c").alias("c"))
    comp = inner.union(top.join(comp.select(F.col("node").alias("c")), "c", "left_anti").select("c", "top"))
    of = nodes.join(comp, nodes.s == comp.node, "left").select("s", "rep", F.coalesce("c", "s").alias("c"))
    label = of.groupBy("c").agg(F.min("rep").alias("component"))
    of = table_at(of.join(label, "c").select(F.col("s").alias("set"), "component"), f"{where}/labels", rows)
    has = F.col("n_shingles") > 0
    out = signed.join(of, has & F.col("doc_id").isNotNull() & (F.col("s") == F.col("set")), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _candidate_sets(text: DataFrame, nodes: DataFrame, members: DataFrame, where: str) -> DataFrame:
    """The whole sets of all nodes that share an index key with another."""
    wanted = table_at(nodes.join(members.select("s").distinct(), "s", "left_semi"), f"{where}/wanted")
    n = wanted.count()
    side = wanted.select("rep", "s")
    side = F.broadcast(side) if n <= SMALL else side
    found = text.join(side, text.doc_id == side.rep).select("s", "text")
    made = found.mapInArrow(tidy(_shingled), "s long, items binary, fine binary").dropDuplicates(["s"])
    return table_at(made.join(wanted.select("s", "n", "sig"), "s"), f"{where}/sets", 5 * n)


def _between(members: DataFrame, sets: DataFrame, comp: DataFrame, least: int, percent: int, symbols: int, where: str) -> DataFrame:
    """Pairs between different components that meet in some bucket, found block by block; each pair once.

    A bucket of more than ``BLOCK`` members is parted into its largest component and the rest. Pairs inside a component aren't sought, so
    blocks of the largest one meet blocks of the rest only: with r members in the rest of m, about m * r / BLOCK rows are moved.
    """
    at = members.join(comp, members.s == comp.node, "left").select("key", "place", "s", F.coalesce("c", "s").alias("c"))
    mixed = at.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key", "size")
    at = table_at(at.join(mixed, "key"), f"{where}/mixed")
    parts = at.where(F.col("size") > BLOCK).groupBy("key", "c").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "c")).alias("main")).select("key", F.col("main.c").alias("main"), F.col("main.n").alias("inside"))
    at = at.join(largest, "key", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    of_rest, of_main = (F.ceil(x / BLOCK).cast("int") for x in (F.col("size") - F.col("inside"), F.col("inside")))
    at = at.withColumns({"of_rest": of_rest, "of_main": of_main, "is_main": F.coalesce(F.col("c") == F.col("main"), F.lit(False))})
    # blocks of the rest come first
    block = F.when(F.col("is_main"), F.col("of_rest") + F.pmod(F.xxhash64("s"), F.greatest("of_main", F.lit(1)))).otherwise(F.pmod(F.xxhash64("s"), "of_rest")).cast("int")
    last = F.when(F.col("is_main"), F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_main")) - 1
    at = at.select("key", "place", "s", "c", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other")).join(sets.select("s", "n", "sig", "fine"), "s")
    at = at.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "place", "s", "c", "n", "sig", "fine")
    return at.groupBy("key", "i", "j").applyInArrow(_across(least, percent, symbols), "a long, b long")
