"""Exact, vectorised encoding with a lower-case word BPE (``word_bpe_49k.json``) over Arrow buffers.

Words of a chunk are found and deduplicated with numpy; the merges of all distinct words run side by side, one lowest-ranked
pair a word and round, which is the order of the ``tokenizers`` library. Rows with characters outside ASCII and Latin-1 letters,
with control characters or with the special tokens' strings go through that library itself, as do words over 64 bytes.
"""

from __future__ import annotations

import json

import numpy as np

from evigraph.llm.common import _rng, ragged, span_hashes, spans, starts_of

_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE, _LETTER, _DIGIT, _OTHER, _UNSAFE = range(5)
_CLASS = np.full(256, _UNSAFE, np.uint8)
_CLASS[32:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NONE = np.int32(2**31 - 1)
_LONG = 64
#: Words whose ids a worker keeps between chunks; beyond that it starts anew, which costs time only.
_KEPT_WORDS = 600_000


def _byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder for the file at ``path``; :meth:`encode` gives flat ids and the number of ids in each row."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + "</w>"] for c in letters], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self._forget()
        self.slots = 1 << 19
        self.keys, self.ranks = np.full(self.slots, -1, np.int64), np.full(self.slots, _NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] >= 0:
                at = (at + 1) % self.slots
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, or _NONE; negative symbols have none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], (at[on] + 1) % self.slots
        return out

    def _merge(self, sym: np.ndarray) -> np.ndarray:
        """Symbols by word, padded with -1, after all merges (in rows padded with -1)."""
        words, width = sym.shape
        out = np.full_like(sym, -1)
        rank = self._rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(words, width - 1)
        row = np.arange(words)
        while len(row):
            at = rank.argmin(1)
            here = np.arange(len(row))
            best = rank[here, at]
            done = best == _NONE
            if done.any():
                out[row[done], : sym.shape[1]] = sym[done]
                on = ~done
                row, sym, rank, at, best = row[on], sym[on], rank[on], at[on], best[on]
                if not len(row):
                    break
                here = np.arange(len(row))
            cols = np.arange(sym.shape[1] - 1)
            sym = np.take_along_axis(sym, cols + (cols > at[:, None]), 1)
            sym[here, at] = self.made[best]
            if sym.shape[1] == 1:
                out[row, 0] = sym[:, 0]
                break
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            inside = at < sym.shape[1] - 1
            rank[here[inside], at[inside]] = self._rank(sym[here[inside], at[inside]], sym[here[inside], at[inside] + 1])
            before = at > 0
            rank[here[before], at[before] - 1] = self._rank(sym[here[before], at[before] - 1], sym[here[before], at[before]])
        return out

    def _words(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of distinct words."""
        counts = np.zeros(len(starts), np.int64)
        groups = []
        low = 0
        for high in (1, 3, 5, 7, 9, 12, 16, 24, 40, _LONG):
            g = np.flatnonzero((lens > low) & (lens <= high))
            low = high
            if not len(g):
                continue
            cols = np.arange(high)
            there = cols < lens[g, None]
            sym = np.where(there, self.inner[data[np.minimum(starts[g, None] + cols, len(data) - 1)]], np.int32(-1))
            sym[np.arange(len(g)), lens[g] - 1] = self.last[data[starts[g] + lens[g] - 1]]
            sym = sym if high == 1 else self._merge(sym)
            counts[g] = (sym >= 0).sum(1)
            groups.append((g, sym[sym >= 0]))
        for k in np.flatnonzero(lens > _LONG):
            ids = self.plain.encode(data[starts[k] : starts[k] + lens[k]].tobytes().decode(), add_special_tokens=False).ids
            counts[k] = len(ids)
            groups.append((np.array([k]), np.array(ids, np.int32)))
        begin = starts_of(counts)
        flat = np.empty(begin[-1], np.int32)
        for g, ids in groups:
            flat[ragged(begin[g], counts[g])] = ids
        return flat, counts

    def _looked_up(self, keys, data, starts, lens) -> tuple[np.ndarray, np.ndarray]:
        """(start in known_ids, ids) of distinct words with sorted keys; new ones are encoded and remembered."""
        if len(self.known) > _KEPT_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        there = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~there)
        if len(new):
            flat, counts = self._words(data, starts[new], lens[new])
            of = starts_of(counts)[:-1] + len(self.known_ids)
            self.known_ids = np.concatenate([self.known_ids, flat])
            place = np.searchsorted(self.known, keys[new])
            self.known = np.insert(self.known, place, keys[new])
            self.known_of = np.insert(self.known_of, place, of)
            self.known_n = np.insert(self.known_n, place, counts)
            at = np.searchsorted(self.known, keys)
        return self.known_of[at], self.known_n[at]

    def _forget(self) -> None:
        self.known, self.known_ids = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.known_of, self.known_n = np.empty(0, np.int64), np.empty(0, np.int64)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(data), len(offsets) - 1
        if not n:
            return np.empty(0, np.int32), np.zeros(rows, np.int64)
        kind = _CLASS[data]
        data = _FOLD[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < n]
        after = data[lead + 1]
        ok = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        kind[lead[ok]] = kind[lead[ok] + 1] = _LETTER
        up = ok & (after < 0x9F)
        data[lead[up] + 1] += 32
        bad = np.zeros(rows, bool)
        if (odd := np.flatnonzero(kind == _UNSAFE)).size:
            bad[np.searchsorted(offsets, odd, side="right") - 1] = True
        raw = None
        for text in self.special:
            raw = data.tobytes() if raw is None else raw
            k = raw.find(text)
            while k >= 0:
                bad[np.searchsorted(offsets, k, side="right") - 1] = True
                k = raw.find(text, k + 1)
        if bad.any():
            kind[np.repeat(bad, np.diff(offsets))] = _SPACE
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        prev = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        start = (kind != _SPACE) & ((prev != kind) | (kind == _DIGIT) | edge[:-1])
        self._contractions(data, kind, start, edge)
        token = kind != _SPACE
        s = np.flatnonzero(start)
        e = np.flatnonzero(token & np.concatenate([~token[1:] | start[1:] | edge[1:-1], np.ones(1, bool)])) + 1
        begin = np.searchsorted(s, offsets)
        keys, first, inverse = np.unique(span_hashes(data, s, e, _CODE), return_index=True, return_inverse=True)
        of, counts = self._looked_up(keys, data, s[first], e[first] - s[first])
        ids = self.known_ids[ragged(of[inverse], counts[inverse])]
        total = np.zeros(len(s) + 1, np.int64)
        np.cumsum(counts[inverse], out=total[1:])
        return ids, np.diff(total[begin]), bad

    @staticmethod
    def _contractions(data, kind, start, edge) -> None:
        """'s 't 'm 'd 're 've 'll after something else than a sign are words of their own."""
        n = len(data)
        q = np.flatnonzero((data == 39) & start)
        q = q[q + 1 < n]
        q = q[~edge[q + 1]]
        if not len(q):
            return
        one = data[q + 1]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        far = np.minimum(q + 2, n - 1)
        two = np.where((q + 2 < n) & ~edge[far], data[far], 0)
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for at, size in ((q[short], 2), (q[pair & ~short], 3)):
            start[at + 1] = False
            nxt = at + size
            nxt = nxt[nxt < n]
            start[nxt] |= kind[nxt] == _LETTER

    def encode(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 21):
        """Yield (first row, last row + 1, flat ids, ids per row) over chunks of about ``most`` bytes."""
        for a, b in spans(offsets, most):
            part = data[offsets[a] : offsets[b]]
            offs = offsets[a : b + 1] - offsets[a]
            got = self._chunk(part, offs)
            ids, counts = got[:2]
            if len(got) > 2 and got[2].any():
                begin = starts_of(counts)
                rows = [ids[begin[k] : begin[k + 1]] for k in range(len(counts))]
                for k in np.flatnonzero(got[2]):
                    text = part[offs[k] : offs[k + 1]].tobytes().decode("utf-8")
                    rows[k] = np.array(self.plain.encode(text, add_special_tokens=False).ids, np.int32)
                counts = np.array([len(r) for r in rows], np.int64)
                ids = np.concatenate(rows) if rows else ids
            yield a, b, ids, counts
