"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared as runs of lower-case letters and digits with one space between. An item of n characters may differ
by k = n * RATE edits; it is split into k + 1 pieces, of which at least one stands unchanged in every text within k edits. An
Aho-Corasick automaton finds the pieces in whole documents, and Myers' bit-parallel distance decides about each place found.

Places are reported from left to right: where an item first ends within its budget, the best of the next k ends is taken (the first of
equals), with the nearest start of that distance; the search goes on behind it, so places of an item are apart and an early one is never lost to a
better one behind it. Items too short for any edit must stand at word edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import filesystem, tidy, workdir

#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of items whose automaton one pass over the documents holds; larger benchmarks take several passes.
BLOCK_CHARS = 8_000_000
HITS = "doc_id long, item_id long, start long, end long, distance int, item_chars int"
_RUN = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Lower case with one space for each run of anything but letters and digits; none at the ends."""
    return _GAP.sub(" ", text.lower()).strip()


def pieces(item: str, rate: float = RATE) -> list[tuple[int, int]]:
    """The k + 1 spans of nearly equal length that an item is split into."""
    n = int(len(item) * rate) + 1
    return [(len(item) * i // n, len(item) * (i + 1) // n) for i in range(n)]


def masks(item: str) -> dict[str, int]:
    """For each character the bits of its places in the item."""
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def distances(peq: dict[str, int], m: int, text: str, whole: bool = False) -> Iterator[int]:
    """For each prefix of ``text`` the least distance of the pattern to a substring that ends there, or with ``whole`` to the prefix itself."""
    pv, mv, score, first = (1 << m) - 1, 0, m, int(whole)
    top, full = 1 << (m - 1), (1 << m) - 1
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv) ^ pv | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | first) & full
        pv = mh << 1 & full | ~(xv | ph) & full
        mv = ph & xv
        yield score


def first_place(peq: dict[str, int], m: int, text: str, a: int, b: int, k: int) -> tuple[int, int]:
    """(distance, end) of the leftmost place in text[a:b]: the best of the k + 1 ends from the first within k on; (k + 1, -1) if none is."""
    best, at, stop = k + 1, -1, -1
    for j, d in enumerate(distances(peq, m, text[a:b]), a + 1):
        if d < best:
            if stop < 0:
                stop = j + k
            best, at = d, j
        if j == stop:
            break
    return best, at


class Matcher:
    """The automaton over the pieces of some items (item_id, plain text)."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        import ahocorasick

        self.items, self.rate = items, rate
        self.masks = [masks(t) for _, t in items]
        self.back = [masks(t[::-1]) for _, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for a, b in pieces(t, rate):
                found.setdefault(t[a:b], []).append((i, a))
        self.tree = ahocorasick.Automaton()
        for piece, where in found.items():
            self.tree.add_word(piece, (len(piece), where))
        if found:
            self.tree.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance) of each separate place in a plain text, sorted."""
        if not self.items:
            return []
        places: dict[int, list[int]] = {}
        for end, (size, where) in self.tree.iter(text):
            for i, a in where:
                places.setdefault(i, []).append(end + 1 - size - a)
        out = []
        for i, begins in places.items():
            item = self.items[i][1]
            m, k = len(item), int(len(item) * self.rate)
            begins.sort()
            if not k:
                done = 0
                for a in begins:
                    if a >= done and text[a - 1 : a] in ("", " ") and text[a + m : a + m + 1] in ("", " "):
                        out.append((i, a, a + m, 0))
                        done = a + m
                continue
            done = at = 0
            while at < len(begins):
                low, high = begins[at] - k, begins[at] + m + k
                while at < len(begins) and begins[at] - k <= high:
                    high = begins[at] + m + k
                    at += 1
                a, b = max(done, low, 0), min(len(text), high)
                while a < b:
                    d, end = first_place(self.masks[i], m, text, a, b, k)
                    if d > k:
                        break
                    back = text[max(a, end - m - k) : end][::-1]
                    start = end - next(j for j, x in enumerate(distances(self.back[i], m, back, True), 1) if x == d)
                    out.append((i, start, end, d))
                    a = done = end
        return sorted(out)


@lru_cache(maxsize=1)
def _matcher(where: str, block: int, rate: float) -> Matcher:
    """The matcher over a block of the items in the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = filesystem(f"{where}/block={block}")
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return Matcher((), rate)
    table = pq.read_table(path, filesystem=files, columns=["item_id", "item"])
    return Matcher(tuple(sorted(zip(table["item_id"].to_pylist(), table["item"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))), rate)


def _original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the plain form as spans of the text itself."""
    at: list[int] = []  # for each plain character, the place of its origin
    for k, c in enumerate(text):
        for x in c.lower():
            if _RUN.fullmatch(x):
                at.append(k)
            elif at and at[-1] >= 0:
                at.append(-1)
    out = []
    for a, b in spans:
        own = [p for p in at[a:b] if p >= 0]
        out.append((own[0], own[-1] + 1) if own else (0, 0))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Each place in ``docs(doc_id, text)`` that is within the edit budget of an item of ``benchmark(item_id, text)``.

    Returns doc_id, item_id, start and end (code points of the text, end exclusive), distance and item_chars; a row for each
    separate place. Null and empty texts match nothing; items without letters or digits are left out; repeated rows on either side
    give repeated results; no rows give no rows. Items are written to the shared folder in blocks of about BLOCK_CHARS characters; each
    block takes one pass over the documents, and tasks read the block of their pass.
    """
    import pyarrow as pa

    where, blocks = items_at(benchmark)

    def run_with(block: int):
        def run(batches):
            m = _matcher(where, block, rate)
            items = m.items
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for k, text in enumerate(batch.column(1)):
                    raw = text.as_py()
                    if found := m.find(plain(raw)):
                        spans = _original(raw, [(a, b) for _, a, b, _ in found])
                        out += [(ids[k], items[i][0], s, e, d, len(items[i][1])) for (i, _, _, d), (s, e) in zip(found, spans, strict=True)]
                cols = list(zip(*out, strict=True)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.int32()) for c in cols[4:])], names=[c.split()[0] for c in HITS.split(", ")])

        return run

    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for block in range(blocks):
        got = text.mapInArrow(tidy(run_with(block)), HITS)
        out = got if out is None else out.union(got)
    return out


def _plain(batches):
    """(item_id, item, size): the plain forms that are not empty."""
    import pyarrow as pa

    for batch in batches:
        forms = [plain(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array([len(x) for x in forms], pa.int64())], names=["item_id", "item", "size"])


def items_at(benchmark: DataFrame) -> tuple[str, int]:
    """Write the plain items of ``benchmark(item_id, text)`` in blocks of the shared folder: (folder, number of blocks, 1 at least)."""
    where = workdir(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_plain, "item_id long, item string, size long").where("size > 0")
    n = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    rows.select("item_id", "item", block.alias("block")).write.partitionBy("block").parquet(where)
    return where, n


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose column ``text`` holds no item of the benchmark within its edit budget; all columns stay.

    Null and empty texts hold none. Repeated rows are judged alike; no rows give no rows.
    """
    import pyarrow as pa

    where, blocks = items_at(benchmark)

    def run_with(block: int):
        def run(batches):
            m = _matcher(where, block, rate)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                keep = [not (t := x.as_py()) or not m.find(plain(t)) for x in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for block in range(blocks):
        docs = docs.mapInArrow(tidy(run_with(block)), docs.schema)
    return docs
