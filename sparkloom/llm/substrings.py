"""Substring deduplication by super-k-mer partitioning.

A window is WINDOW consecutive words of a document. Its minimiser is the pair of neighbouring words of least hash in it (a pair,
because a frequent word of low hash would draw a large part of all windows to itself). Consecutive windows with the same
minimiser travel together as one packed string of their words to the minimiser's bucket, so equal windows always meet, and
each word is sent about three times. In a bucket, windows are sorted by a hash of their bytes, and neighbours of equal hash
are compared byte by byte; each run of equal windows then knows its smallest document. Every window that also starts in a
document with a smaller doc_id marks its words.

Nothing unbounded meets in one task:
* a task that has seen a packed string in a smaller document marks the larger one's words at once and sends nothing, so a
  bucket gets a string once for each FLUSH bytes of a task at most, not once for each copy;
* the number of places that buckets are dealt to follows the corpus (PLACE bytes of words each). A run of FLUSH bytes sends
  one compressed block to each place, whatever the number of buckets in it. At the place every block is opened once, its
  strings are dealt to PARTS parts by their minimisers' hashes, and these go, compressed again, through Spark's sort, which
  spills; so one part is open at a time, and a part that a frequent minimiser makes too large is cut by further bits, up to 256
  times; only one minimiser's strings open together.

Marks come back as rows (doc_id, tag, start, end), tag being a hash of the text, are gathered for each document, and meet its
text again in a join by both.

Defined results: null and empty texts have no words; a null doc_id is larger than every other; rows that repeat a doc_id are
versions of one document, which can't mark each other's words, each marked where its own windows start in a smaller one; an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release, written

WINDOW = 13
#: Bytes of a place's packed strings, of those that are opened together, of texts that a task packs together, and of parts that
#: a place holds before they go on; parts of a place; the most partitions of places.
PLACE, OPEN, FLUSH, HELD, PARTS, PARTITIONS = 32_000_000, 2_000_000, 3_500_000, 8_000_000, 24, 20_000
#: Bytes whose sums are held together.
CHUNK = 1 << 19


_powers: list[np.ndarray] = []
_ODD = 0x9E3779B97F4A7C15


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n + 1:
        n = 1 << n.bit_length()
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64)), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _powers[0], _powers[1]


def range_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes, from sums over all before it in a chunk. Both ends rise from range to range."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        x, y = start[i:j] - base, end[i:j] - base
        up, down = _power(int(y[-1]))
        sums = np.zeros(int(y[-1]) + 1, np.uint64)
        np.cumsum((codes[base : base + int(y[-1])].astype(np.uint64) + np.uint64(1)) * up[: int(y[-1])], out=sums[1:])
        out[i:j] = _mixed((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64))
        i = j
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def spaced(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text with every run of white space as one space; where its words begin and end there; where they began in raw."""
    codes = np.frombuffer(raw, np.uint8)
    space = _SPACES[codes]
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    text = np.where(space[at], np.uint8(32), codes[at])
    edge = np.diff(np.concatenate([[True], text == 32, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return text, start, end, at[start]


def minimisers(hashes: np.ndarray, k: int) -> np.ndarray:
    """For each window of k hashes, (hash << 32 | place) of its least, the leftmost of equals."""
    x = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= k:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = k - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


#: Bytes of a packed string's document (less the one before), whether that is null, tag, place, and its minimiser's part and spare bits.
WIDTHS = (8, 1, 8, 4, 1, 1)


def heads_out(head: np.ndarray) -> bytes:
    """The columns of packed strings, byte by byte, so that they compress."""
    cols = np.diff(head[:, 0], prepend=0), *head[:, 1:].T
    return b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(cols, WIDTHS, strict=True))


def heads_in(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    at, cols = 8, []
    for w in WIDTHS:
        c = np.zeros((n, 8), np.uint8)
        c[:, :w] = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T
        cols.append(c.view("<i8").reshape(n))
        at += n * w
    return np.stack([np.cumsum(cols[0]), *cols[1:]], axis=1), at


def block_out(pack: zstandard.ZstdCompressor, heads: np.ndarray, texts: list[bytes]) -> bytes:
    return pack.compress(len(texts).to_bytes(8, "little") + heads_out(heads) + b"\n".join(texts))


def block_in(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    heads, at = heads_in(raw, int.from_bytes(raw[:8], "little"))
    return heads, raw[at:].split(b"\n")


def _send(k: int, places: int):
    """Map side: (place, part, block) rows. A block holds packed strings; or, with part -1, marks that are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7)
        raws: list[bytes] = []
        owners: list[tuple[int, int, int]] = []  # doc_id, null or not, tag
        rows_seen: set[tuple[int, int, int]] = set()  # a repeated row has the marks of the first
        size = 0

        def flush() -> pa.RecordBatch:
            codes, start, end, begun = spaced(b"\n".join(raws))
            text = codes.tobytes()
            offsets = np.cumsum([0, *(len(r) + 1 for r in raws[:-1])])
            doc_of = np.searchsorted(offsets, begun, "right") - 1
            base = np.searchsorted(doc_of, np.arange(len(raws)))  # each document's first word
            h = range_hashes(codes, start, end)
            h = _mixed(h[:-1] * np.uint64(_ODD) + h[1:]) >> np.uint64(32)  # of each word and the next
            least = minimisers(h, k - 1) if len(h) >= k - 1 else np.zeros(0, np.uint64)
            inside = doc_of[: len(least)] == doc_of[k - 1 :]
            change = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc_of[1 : len(least)] != doc_of[: len(least) - 1]))) if len(least) else np.zeros(0, np.int64)
            ends = np.append(change[1:], len(least)) if len(change) else change
            # windows that reach over a document's end are the last k - 1 of its words
            valid = np.append(0, np.cumsum(inside))
            last = change + (valid[ends] - valid[change]) if len(change) else change
            keep = last > change
            change, last = change[keep], last[keep]
            of = doc_of[change]
            ids, nulls, tags = (np.array([o[i] for o in owners], np.int64)[of] for i in range(3))
            order = np.lexsort((ids, nulls))  # the smallest document first
            m = (least[change] >> np.uint64(32)).astype(np.int64)
            heads = np.stack([ids, nulls, tags, change - base[of], m // places % PARTS, m // (places * PARTS) % 256], axis=1)
            columns = (start[change], end[last + k - 2], last + k - 1 - base[of], m % places, ids, nulls)
            seen: dict[bytes, tuple[int, int]] = {}
            sent: dict[int, tuple[list[int], list[bytes]]] = {}
            marks: list[list[int]] = []
            for at, x, y, b, place, doc, null in zip(order.tolist(), *(c[order].tolist() for c in columns), strict=True):
                string = text[x:y]
                if seen.setdefault(string, (null, doc)) < (null, doc):
                    _, _, tag, a, *_ = heads[at].tolist()
                    if marks and marks[-1][:3] == [doc, null, tag] and marks[-1][3] <= a <= marks[-1][4]:
                        marks[-1][4] = b
                    else:
                        marks.append([doc, null, tag, a, b])
                else:
                    own = sent.setdefault(place, ([], []))
                    own[0].append(at)
                    own[1].append(string)
            rows = [(place, 0, block_out(pack, heads[at], strings)) for place, (at, strings) in sent.items()]
            for at in range(0, len(marks), 100_000):
                rows.append(((zlib.crc32(text[:1000]) + at) % places, -1, pack.compress(np.array(marks[at : at + 100_000], "<i8").tobytes())))
            for x in (raws, owners, rows_seen):
                x.clear()
            release()
            return _rows(rows)

        for batch in batches:
            for doc, tag, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = value.as_buffer().to_pybytes()
                owner = (doc or 0, int(doc is None), tag)
                if raw and owner not in rows_seen:
                    rows_seen.add(owner)
                    owners.append(owner)
                    raws.append(raw)
                    size += len(raw)
                    if size >= FLUSH:
                        yield flush()
                        size = 0
        if raws:
            yield flush()

    return run


BLOCKS = "place bigint, part int, block binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["place", "part", "block"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a place, in any order, as blocks of its parts; HELD bytes at a time."""
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    held: dict[tuple[int, int], tuple[list[np.ndarray], list[bytes]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(place, part, block_out(pack, np.concatenate(heads), texts)) for (place, part), (heads, texts) in held.items()]
        held.clear()
        release()
        return _rows(rows)

    for batch in batches:
        for place, part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part < 0:
                yield _rows([(place, part, block)])
                continue
            raw = unpack.decompress(block)
            heads, texts = block_in(raw)
            order = np.argsort(heads[:, 4], kind="stable")
            edges = np.searchsorted(heads[order, 4], np.arange(PARTS + 1))
            for p in range(PARTS):
                if edges[p + 1] > edges[p]:
                    mine = order[edges[p] : edges[p + 1]]
                    own = held.setdefault((place, p), ([], []))
                    own[0].append(heads[mine])
                    own[1].extend(texts[i] for i in mine.tolist())
            size += len(raw)
            if size >= HELD:
                yield out()
                size = 0
    if held:
        yield out()
    release()


def repeats(texts: list[bytes], heads: np.ndarray, k: int) -> np.ndarray:
    """(doc, null, tag, start, end) rows of the words of windows that also start in a smaller document, among packed strings."""
    docs, nulls, tags, places = heads[:, :4].T
    joined = b"\n".join(texts)
    codes = np.frombuffer(joined, np.uint8)
    border = (codes == 32) | (codes == 10)
    start = np.append(0, np.flatnonzero(border) + 1)
    end = np.append(start[1:] - 1, len(codes))
    lengths = np.bincount(np.append(0, np.cumsum(codes[border] == 10)), minlength=len(texts))
    n = lengths - k + 1
    first = np.append(0, np.cumsum(lengths)[:-1])
    string = np.repeat(np.arange(len(texts)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
    at = first[string] + within
    x, y = start[at], end[at + k - 1]  # a window's words stand side by side
    h = range_hashes(codes, x, y)
    order = np.lexsort((docs[string], nulls[string], h))
    same = np.append(False, h[order][1:] == h[order][:-1])
    pairs = np.flatnonzero(same)
    one, two = order[pairs], order[pairs - 1]
    if any(joined[a:b] != joined[c:d] for a, b, c, d in zip(x[one].tolist(), y[one].tolist(), x[two].tolist(), y[two].tolist(), strict=True)):
        # different windows of one hash: they are numbered by their bytes, and sorted by that
        numbers: dict[bytes, int] = {}
        h = np.array([numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(x.tolist(), y.tolist(), strict=True)])
        order = np.lexsort((docs[string], nulls[string], h))
        same = np.append(False, h[order][1:] == h[order][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    d, null = docs[string][order], nulls[string][order]
    hit = np.sort(order[(null > null[head]) | (null == null[head]) & (null == 0) & (d > d[head])])  # windows in the order of their strings
    if not len(hit):
        return np.zeros((0, 5), np.int64)
    begin = np.append(True, (np.diff(hit) > 1) | (np.diff(string[hit]) != 0))
    a, b = hit[begin], hit[np.append(np.flatnonzero(begin)[1:] - 1, len(hit) - 1)]
    s = string[a]
    return np.stack([docs[s], nulls[s], tags[s], places[s] + within[a], places[s] + within[b] + k], axis=1)


def _count(k: int):
    """Blocks come sorted by place and part; one part is held at a time, compressed, and opened in pieces if it is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def out(marks: np.ndarray) -> pa.RecordBatch:
            doc, null, *rest = marks.T
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null == 1), *(pa.array(c, pa.int64()) for c in rest)], names=["doc_id", "tag", "start", "end"])

        def work(blocks: list[bytes], size: int) -> Iterator[pa.RecordBatch]:
            pieces = min(256, max(1, -(-size // OPEN)))
            for piece in range(pieces):
                texts: list[bytes] = []
                heads = []
                for block in blocks:
                    head, own = block_in(unpack.decompress(block))
                    if pieces > 1:
                        mine = np.flatnonzero(head[:, 5] % pieces == piece)
                        head, own = head[mine], [own[i] for i in mine.tolist()]
                    texts += own
                    heads.append(head)
                if texts:
                    yield out(repeats(texts, np.concatenate(heads), k))
                    del texts, heads
                    release()

        held, size, at = [], 0, None
        for batch in batches:
            for place, part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    yield out(np.frombuffer(unpack.decompress(block), "<i8").reshape(-1, 5))
                    continue
                if (place, part) != at:
                    yield from work(held, size)
                    held, size, at = [], 0, (place, part)
                held.append(block)
                size += zstandard.get_frame_parameters(block).content_size
        yield from work(held, size)
        held.clear()
        release()

    return run


def _apply(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, n, gone, sha, kept_text = batch.column(0), [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split()
                n.append(len(words))
                if spans.is_valid and len(spans):
                    flat = spans.values.flatten()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, flat[0].to_numpy(), 1)
                    np.add.at(edge, flat[1].to_numpy(), -1)
                    free = np.cumsum(edge[:-1]) == 0
                    kept = [words[i] for i in np.flatnonzero(free).tolist()]
                else:
                    kept = words
                gone.append(len(words) - len(kept))
                raw = b" ".join(kept)
                sha.append(hashlib.sha256(raw).hexdigest())
                kept_text.append(raw)
            yield pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept_text, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, UTF-8, joined by one space) of each row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    df = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(raw).alias("tag"), raw.alias("raw"))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    places = max(1, math.ceil(size * 3 / PLACE))
    sent = df.mapInArrow(_send(k, places), BLOCKS).repartition(min(places, PARTITIONS), "place").mapInArrow(_deal, BLOCKS)
    with batches_of(docs.sparkSession, 64):
        marks = written(sent.sortWithinPartitions("place", "part").mapInArrow(_count(k), "doc_id bigint, tag bigint, start bigint, end bigint"), "substrings-marks")
    spans = marks.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "spans")
    out = df.join(spans, df["doc_id"].eqNullSafe(F.col("d")) & (df["tag"] == F.col("t")), "left").select("doc_id", "raw", "spans")
    return out.mapInArrow(_apply(k), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")


ORACLE_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS HUGEINT), CAST(9223372036854775808 AS HUGEINT)) AS d, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, d, i, w[i : i + {WINDOW - 1}] AS g FROM (SELECT r, d, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT r, i, d, min(d) OVER (PARTITION BY g) AS least FROM win) WHERE least < d),
left_words AS (SELECT r, count(g.p) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (g.p IS NULL) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) LEFT JOIN gone g USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_words USING (r)"""
