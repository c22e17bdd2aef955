"""Packing of tokenized documents into windows by non-negative least squares over a length histogram.

Every document is cut into whole windows and one shorter tail. The histogram of the tails, on a coarse grid of lengths, is all
that reaches the driver. Every combination of at most ``depth`` grid lengths that fills a window is a column of a system whose
non-negative least-squares solution says how often each combination is to be used. Shards of tails then take their share of
these counts, rounded down, side by side, and what is left over is packed greedily by best fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import starts_of, table_at, tidy, utf8_of, workdir

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
#: Least sequence_id of the pieces that fill a whole window; those of shards are below.
FULL = 1 << 62
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        from evigraph.llm.wordbpe import WordBpe

        _encoders[path] = WordBpe(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize ``docs(doc_id, text)`` and cut each document, closed by the id ``end``, into pieces of at most ``window`` ids.

    A null text counts as empty and gives one piece with the id ``end`` only. Repeated rows give repeated pieces, and a null
    doc_id is carried on. Other columns are ignored. ``with_ids`` adds the ids themselves (little-endian uint32).
    """
    import pyarrow as pa

    def cut(batches):
        enc, row = _encoder(tokenizer), 0
        for batch in batches:
            doc = batch.column(0).to_pylist()
            data, offsets = utf8_of(batch.column(1))
            for a, b, ids, counts in enc.encode(data, offsets):
                begin, out, raw = starts_of(counts), [], []
                for k in range(b - a):
                    full = np.append(ids[begin[k] : begin[k + 1]], np.int32(end)).astype("<u4").tobytes()
                    n = len(full) // 4
                    for s in range(0, n, window):
                        piece = full[4 * s : 4 * (s + window)]
                        out.append((doc[a + k], s, len(piece) // 4, zlib.crc32(piece), n, row))
                        row += 1
                        if with_ids:
                            raw.append(piece)
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] + [pa.array(raw, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(cut), PIECE + ", ids binary" * with_ids)


def combinations(cells: int, depth: int) -> list[tuple[int, ...]]:
    """The non-increasing tuples of at most ``depth`` positive integers with the sum ``cells``."""
    out: list[tuple[int, ...]] = []

    def go(left: int, most: int, head: tuple[int, ...]) -> None:
        if not left:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(head)) < left:
                    break
                go(left - x, x, (*head, x))

    go(cells, cells, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The x >= 0 with the least |ax - b|, by the active sets of Lawson and Hanson; after ``rounds`` the best so far."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, ab = a.T @ a, a.T @ b
    for _ in range(rounds):
        w = ab - gram @ x
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-9 * max(1.0, float(np.abs(ab).max(initial=0.0))):
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            z = np.linalg.lstsq(gram[np.ix_(p, p)], ab[p], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            low = z <= 0
            step = np.min(x[p][low] / np.maximum(x[p][low] - z[low], 1e-300))
            x[p] += step * (z - x[p])
            passive[p[x[p] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int], cells: int = 64, depth: int = 3) -> list[tuple[tuple[int, ...], float]]:
    """How often each combination of grid lengths should be used for tails counted by grid length."""
    combos = combinations(cells, depth)
    a = np.zeros((cells, len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[x - 1, j] += 1
    b = np.array([histogram.get(k, 0) for k in range(1, cells + 1)], float)
    # a long tail left over costs more padding than a short one, which fits in many gaps
    weight = np.sqrt(np.arange(1, cells + 1))
    x = nnls(a * weight[:, None], b * weight)
    return [(c, float(v)) for c, v in zip(combos, x, strict=True) if v > 1e-6]


def pack_shard(lengths: np.ndarray, mix: list[tuple[tuple[int, ...], float]], share: float, window: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence of each piece, offset in it) for one shard that takes ``share`` of the planned counts."""
    step = window // cells
    cell = np.minimum(-(-lengths // step), cells)
    stock: list[list[int]] = [[] for _ in range(cells + 1)]
    for k in np.lexsort((np.arange(len(lengths)), lengths)):
        stock[cell[k]].append(int(k))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []

    def put(k: int, s: int) -> None:
        sequence[k], offset[k] = s, fill[s]
        fill[s] += int(lengths[k])

    for combo, count in mix:
        for _ in range(int(count * share)):
            took = []
            for c in combo:
                if stock[c]:
                    took.append(stock[c].pop())
            if len(took) < len(combo):
                for k in reversed(took):
                    stock[cell[k]].append(k)
                break
            fill.append(0)
            for k in took:
                put(k, len(fill) - 1)
    gaps: dict[int, list[int]] = {}
    sizes: list[int] = []

    def opened(s: int) -> None:
        gap = window - fill[s]
        if gap:
            if gap not in gaps:
                insort(sizes, gap)
            gaps.setdefault(gap, []).append(s)

    for s in range(len(fill)):
        opened(s)
    for c in range(cells, 0, -1):
        for k in sorted(stock[c], key=lambda k: (-lengths[k], k)):
            i = bisect_left(sizes, int(lengths[k]))
            if i == len(sizes):
                fill.append(0)
                s = len(fill) - 1
            else:
                gap = sizes[i]
                s = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(i)
            put(k, s)
            opened(s)
    return sequence, offset


def pack(cut: DataFrame, window: int = 4096, cells: int = 64, depth: int = 3, shard_rows: int = 8000) -> DataFrame:
    """Assign pieces (as :func:`pieces` makes them, from a table that can be read twice) to sequences of at most ``window``.

    Returns each piece with sequence_id and a gapless offset from 0 within it. Pieces stay whole. No rows give no rows. A shard
    holds about ``shard_rows`` tails whatever the input's size; repeated rows are spread by their salt. Pieces of a whole window
    are sequences as they are.
    """
    import pyarrow as pa

    step = window // cells
    short, full = cut.where(F.col("length") < window), cut.where(F.col("length") >= window)
    tails = short.groupBy(F.ceil(F.col("length") / step).cast("int").alias("cell")).count().collect()
    total = sum(r["count"] for r in tails)
    mix = plan({r["cell"]: r["count"] for r in tails}, cells, depth) if total else []
    shards = max(1, -(-total // shard_rows))

    def shard(key, table):
        order = [("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")]
        table = table.combine_chunks().sort_by(order)
        n = table.column("length").to_numpy()
        sequence, offset = pack_shard(n, mix, len(n) / total, window, cells)
        base = key[0].as_py() << 40
        table = table.drop_columns(["salt", "shard"])
        return table.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    schema = PACKED.replace("sequence_id", "ids binary, sequence_id") if "ids" in cut.columns else PACKED
    salted = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(shards)))
    packed = salted.groupBy("shard").applyInArrow(shard, schema)
    # a piece that fills a sequence has one to itself, numbered from FULL on, and isn't moved
    alone = full.withColumn("sequence_id", F.lit(FULL) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.select(*packed.columns))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, with_ids: bool = False) -> DataFrame:
    """:func:`pieces` written once to the shared folder, then :func:`pack`."""
    return pack(table_at(pieces(docs, tokenizer, window, with_ids=with_ids), workdir(docs.sparkSession, "pieces")), window)
