"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as code points in lower case, with every run of other characters than letters and digits as one space.
An item of more than SEGMENT characters is cut into segments of that many, STRIDE apart; one of up to SEGMENT + WINDOW / 2 is
a segment as a whole (too). A segment of m characters may differ by k = min(EDITS * m, (m - Q) / Q) edits, rounded down: a
tenth, but 2 for 30 and 31 characters. As STRIDE isn't above the edits of a segment, any verbatim quote of SEGMENT less those
(87) characters of a longer item is found, wherever it starts; of shorter items, nine tenths. If a text holds a segment so, then at least m - Q + 1 - k * Q of the segment's q-grams stand in the text on diagonals (text place less
segment place) at most k apart. So the q-grams' hits are counted, for the segments that start within WINDOW together, in diagonal bands, each overlapping the next by half; bands
with fewer hits than the lemma asks are left, and in the rest a banded alignment finds the least edits. An item's segment
within its budget marks the document.

The benchmark is a stated query set: its index is broadcast in blocks of about BLOCK characters (some 100 bytes a character),
one pass over the documents for each, and documents aren't shuffled. With more than one block, what a pass finds or keeps is
written and its index released before the next is made, so one index is held at a time.

An item shorter than LEAST normalised characters is held where it stands whole, without an edit, between word borders.

Defined results: null and empty texts hold nothing; an item that is null, or without a letter or digit, matches nothing; repeated rows each get their rows, equal items too; an empty table on either side gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written

Q, EDITS, LEAST = 8, 0.1, 30
SEGMENT, STRIDE, WINDOW = 96, 8, 32
#: Diagonals of half a band; more than the edits of the longest segment.
BAND = 16
#: Characters of one block of the benchmark, and of documents that are looked at together.
BLOCK, TOGETHER = 1_500_000, 1_000_000
SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, n_segments bigint, n_matched bigint, edits bigint"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(64 - 22)
_table: list[np.ndarray] = []


def _lut() -> np.ndarray:
    """Normalised code points of the first plane: one lower-case letter or digit, else a space; 0 stays, as a border."""
    if not _table:
        t = np.full(65536, 32, np.uint32)
        for c in range(1, 65536):
            x = chr(c)
            if x.isalnum():
                t[c] = ord(low) if len(low := x.lower()) == 1 else c
        t[0] = 0
        _table.append(t)
    return _table[0]


def normalised(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points and where each stood."""
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(raw < 65536, _lut()[np.minimum(raw, 65535)], raw)
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[1:] &= ~(space[1:] & (codes[:-1] == 0))  # no space at a text's start
    at = np.flatnonzero(keep)
    return codes[at], at


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q = 8 characters from each place."""
    n = len(codes) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    c, b, mask = codes.astype(np.uint64), int(_BASE), (1 << 64) - 1
    b2, b4 = np.uint64(b**2 & mask), np.uint64(b**4 & mask)
    two = c[:-1] * _BASE + c[1:]
    four = two[:-2] * b2 + two[2:]
    eight = four[:-4] * b4 + four[4:]
    return (eight ^ (eight >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The segments of a block of items, and where each q-gram stands in windows of neighbouring segments; and the short items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.item, self.total, kept, begin, size, windows, base = [], [], [], [], [], [], 0
        short: dict[int, dict[bytes, list]] = {}
        with np.errstate(over="ignore"):
            for item, text in items:
                codes, _ = normalised("\0" + text.replace("\0", " "))
                codes = codes[1:]
                while len(codes) and codes[-1] == 32:
                    codes = codes[:-1]
                n = len(codes)
                if n < LEAST:
                    if n:
                        short.setdefault(n, {}).setdefault(codes.tobytes(), []).append(item)
                    continue
                own = [(0, n)] if n <= SEGMENT + WINDOW // 2 else []
                first = len(begin)
                windows += [(base, n, first, 1)] * len(own)
                if n > SEGMENT:
                    starts = sorted({*range(0, n - SEGMENT, STRIDE), n - SEGMENT})
                    for _, group in groupby(starts, lambda x: x // WINDOW):
                        near = list(group)
                        windows.append((base + near[0], near[-1] - near[0] + SEGMENT, first + len(own), len(near)))
                        own += [(x, SEGMENT) for x in near]
                begin += [base + x for x, _ in own]
                size += [m for _, m in own]
                self.item += [item] * len(own)
                self.total += [len(own)] * len(own)
                kept.append(codes)
                base += n
            self.text = np.concatenate(kept) if kept else np.zeros(0, np.uint32)
            self.begin, self.m = np.array(begin, np.int64), np.array(size, np.int64)
            self.k = np.minimum((self.m * EDITS).astype(np.int64), np.maximum((self.m - Q) // Q, 0))
            self.at, _, self.own, self.n_own = np.array(windows, np.int64).reshape(-1, 4).T
            self.need = (self.m - Q + 1 - self.k * Q)[self.own]  # a window's segments are of one length
            hashes = [grams(self.text[x : x + m]) for x, m, _, _ in windows]
            self.short = {m: self._short(m, found) for m, found in sorted(short.items())}
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
        off = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        if len(flat):
            # a window's commonest q-grams are left out, up to half of the hits it needs, and it needs as many fewer
            _, back, n = np.unique(flat, return_inverse=True, return_counts=True)
            by = np.lexsort((off, -n[back], seg))
            rank = np.empty(len(flat), np.int64)
            rank[by] = np.arange(len(flat)) - np.searchsorted(seg, seg[by])
            out = (rank < self.need[seg] // 2) & (n[back] > SEGMENT // WINDOW + 1)
            self.need = self.need - np.bincount(seg[out], minlength=len(self.need))
            flat, seg, off = flat[~out], seg[~out], off[~out]
        order = np.argsort(flat, kind="stable")
        self.seg, self.off = seg[order].astype(np.int32), off[order].astype(np.int16)
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> _BITS] = True

    @property
    def codes(self) -> list[np.ndarray]:
        """The characters of each segment."""
        return [self.text[x : x + m] for x, m in zip(self.begin, self.m, strict=True)]

    @staticmethod
    def _short(m: int, found: dict[bytes, list]) -> tuple[np.ndarray, np.ndarray, list]:
        """Sorted hashes of short items of m characters, the characters, and who has them."""
        texts = np.stack([np.frombuffer(x, np.uint32) for x in found])
        hashes = (texts.astype(np.uint64) * np.cumprod(np.full(m, _BASE))).sum(axis=1, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        own = list(found.values())
        return hashes[order], texts[order], [own[i] for i in order]

    def whole(self, codes: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
        """Short items that stand in codes between word borders: item, start, end."""
        if not self.short:
            return
        border = (codes == 32) | (codes == 0)
        starts = np.flatnonzero(~border & np.append(True, border[:-1]))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(codes), _BASE))
            back = np.cumprod(np.full(len(codes), np.uint64(pow(int(_BASE), -1, 1 << 64))))
            sums = np.append(np.uint64(0), np.cumsum(codes.astype(np.uint64) * powers, dtype=np.uint64))
            for m, (hashes, texts, own) in self.short.items():
                at = starts[starts + m <= len(codes)]
                at = at[np.append(border, True)[at + m]]
                h = (sums[at + m] - sums[at]) * np.where(at > 0, back[at - 1], np.uint64(1))
                place = np.searchsorted(hashes, h)
                hit = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == h)
                for x, i, key in zip(at[hit].tolist(), place[hit].tolist(), h[hit], strict=True):
                    while i < len(hashes) and hashes[i] == key:
                        if (codes[x : x + m] == texts[i]).all():
                            yield from ((item, x, x + m) for item in own[i])
                        i += 1

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments whose window has enough hits in codes, and the least diagonal of the band."""
        with np.errstate(over="ignore"):
            h = grams(codes)
        at = np.flatnonzero(self.maybe[h >> _BITS])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[place] == h[at]
        at, place = at[real], place[real]
        n = (self.first[place + 1] - self.first[place]).astype(np.int64)
        which = np.repeat(self.first[place] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        seg = self.seg[which].astype(np.int64)
        band = (np.repeat(at, n) - self.off[which]) // BAND + 64  # never below 0
        wide = np.int64(1) << np.int64(32)
        key, hits = np.unique(seg * wide + band, return_counts=True)
        # every band, and the one before the first of a run, with the hits of its two halves
        key, hits = np.append(key, key - 1), np.append(hits, hits)
        key, back = np.unique(key, return_inverse=True)
        both = np.bincount(back, hits).astype(np.int64)
        seg, band = key // wide, key % wide - 64
        ok = both >= self.need[seg]
        window, low = seg[ok], band[ok] * BAND
        n = self.n_own[window]
        which = np.repeat(self.own[window] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return which, np.repeat(low - self.at[window], n) + self.begin[which]

    def align(self, codes: np.ndarray, seg: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each segment in its band, with start and end in codes; segments are of one length."""
        m, k = int(self.m[seg[0]]), int(self.k[seg[0]])
        lo, wide = low - k, 2 * BAND + 2 * k + 1
        place = lo[:, None] + np.arange(m + wide)
        text = np.where((place >= 0) & (place < len(codes)), codes[np.clip(place, 0, len(codes) - 1)], 0).astype(np.int64)
        pattern = self.text[self.begin[seg][:, None] + np.arange(m)].astype(np.int64)
        unit = np.int64(1) << np.int64(20)  # costs are counted in this; below it, the start's place
        cost = np.where(text == 0, 1000, 1) * unit  # of passing a character of the text: borders can't be passed
        far = np.full((len(seg), 1), 1 << 40, np.int64)
        d = np.broadcast_to(np.arange(wide), (len(seg), wide)).astype(np.int64)
        for i in range(m):
            here = text[:, i : i + wide]
            step = np.minimum(d + np.where(here == pattern[:, i : i + 1], 0, np.where(here == 0, 1000, 1)) * unit, np.concatenate([d[:, 1:], far], axis=1) + unit)
            run = np.cumsum(cost[:, i : i + wide], axis=1)
            d = np.minimum.accumulate(step - run, axis=1) + run
        best = d.argmin(axis=1)
        least = d[np.arange(len(seg)), best]
        return least // unit, lo + least % unit, lo + m + best


def _find(index: Index, ids: list, texts: list[str]) -> Iterator[tuple]:
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    codes, at = normalised(joined)
    seg, band = index.regions(codes)
    borders = np.flatnonzero(codes == 0)
    found: dict[tuple[int, int], list] = {}
    for m in np.unique(index.m[seg]) if len(seg) else ():
        own = np.flatnonzero(index.m[seg] == m)
        for part in range(0, len(own), 2000):
            s, b = seg[own[part : part + 2000]], band[own[part : part + 2000]]
            edits, start, end = index.align(codes, s, b)
            for x in np.flatnonzero(edits <= index.k[s]):
                doc = int(np.searchsorted(borders, start[x], "right")) - 1
                origin = at[borders[doc]] + 1
                found.setdefault((doc, index.item[s[x]], index.total[s[x]]), []).append((int(s[x]), int(edits[x]), int(at[start[x]] - origin), int(at[end[x] - 1] + 1 - origin)))
    for item, start, end in index.whole(codes):
        doc = int(np.searchsorted(borders, start, "right")) - 1
        origin = at[borders[doc]] + 1
        found.setdefault((doc, item, 1), []).append((-1, 0, int(at[start] - origin), int(at[end - 1] + 1 - origin)))
    for (doc, item, total), hits in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1]))):
        best: dict[int, int] = {}
        for s, e, _, _ in hits:
            best[s] = min(e, best.get(s, e))
        yield ids[doc], item, min(h[2] for h in hits), max(h[3] for h in hits), total, len(best), sum(best.values())


def _pass(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(ids: list, texts: list) -> pa.RecordBatch:
            rows = list(_find(index.value, ids, texts))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    ids.append(doc)
                    texts.append(text)
                    size += len(text)
                if size >= TOGETHER:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield out(ids, texts)
            release()

    return run


def _clean(index, at: int):
    """The rows of each batch without a leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            bad, own, size = set(), [], 0
            for i, t in enumerate(texts):
                if t:
                    own.append(i)
                    size += len(t)
                if own and (size >= TOGETHER or i == len(texts) - 1):
                    bad.update(r[0] for r in _find(index.value, own, [texts[x] for x in own]))
                    own, size = [], 0
            release()
            yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_())) if bad else batch

    return run


def _indexes(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, block: int) -> Iterator:
    """The benchmark's blocks, each an index that every executor has, and whether it is the only one."""
    items = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block) or 1
    for b in range(n):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).orderBy("item", "text").collect()  # about block characters
        yield docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in own])), n == 1


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document row and item of which it holds a segment: SCHEMA; start and end are code points of the text."""
    own, found = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), []
    for index, only in _indexes(docs, benchmark, item, item_text, block):
        rows = own.mapInArrow(_pass(index), SCHEMA)
        found.append(rows if only else written(rows, "leaks"))
        if not only:
            index.destroy()
    return reduce(DataFrame.union, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no segment, with all their columns."""
    at, kept = docs.columns.index(text), docs
    for index, only in _indexes(docs, benchmark, item, item_text, block):
        kept = kept.mapInArrow(_clean(index, at), docs.schema)
        if not only:
            kept = written(kept, "without-leaks")
            index.destroy()
    return kept
