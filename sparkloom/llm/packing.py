"""Hierarchical packing into sequences of several lengths.

A document's tokens are cut into whole windows of the longest tier and a rest; the rest goes to the shortest tier that holds
it. Each tier is packed by best fit, rests in order of falling length; gaps in windows of longer tiers are then filled from
shorter tiers, cutting a piece where it doesn't fit whole. What stays in a shorter tier becomes windows of that tier's
length, so that a full window of any tier, a power of two, needs no padding. Sequences are dealt to step groups of equal
token budget.

Packing needs no order over the corpus: each task packs runs of documents of at most RUN tokens by itself, carrying what is
left to its next run, so memory is bounded and a lost executor costs its own tasks again. Padding is at most one window of
each tier for each task.

Token ids are those of the byte-level BPE in byte_bpe_50k.json. They are made by its twin, the same vocabulary and pattern as
ranks, which is several times as fast; a text that holds the special token's own string goes to the tokenizer itself.

Defined results: a null text is empty, and an empty document is its end token alone; repeated rows are packed each; an empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
END = 1
RUN = 2_000_000
#: Tokens of one step's sequences, padding included, over all of a group's members.
STEP = 16 * 2048
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, tier int, step_group bigint"


def tokenizer(vocabulary: str | None = None):
    """A function from a text to its ids (numpy, unsigned 32 bits), without an end token. vocabulary: path of byte_bpe_50k.json, with its .tiktoken beside it."""
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    with open(path.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


class Packer:
    """Packs pieces (document, start, length) into sequences; ends them in order; see the module's text."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.top = tiers, tiers[-1]

    def windows(self, pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """Sequences, each a list of pieces, that hold every token of pieces."""
        out, rests = [], []
        for doc, start, length in pieces:
            whole = length - length % self.top
            out += [[(doc, start + at, self.top)] for at in range(0, whole, self.top)]
            if length > whole:
                rests.append((length - whole, doc, start + whole))
        tiers: dict[int, list] = {t: [] for t in self.tiers}
        for r in sorted(rests, key=lambda r: (-r[0], r[1], r[2])):
            tiers[self.tiers[bisect_left(self.tiers, r[0])]].append(r)
        shorter: list[tuple[int, int, int]] = []  # what longer tiers can draw on: (length, doc, start), sorted
        for t in self.tiers[:-1]:
            for r in tiers[t]:
                insort(shorter, r)
        packed: list[tuple[int, list]] = []
        for t in reversed(self.tiers):
            own = [r for r in tiers[t] if t == self.top or self._take(shorter, r)]
            gaps: list[tuple[int, int]] = []  # (room, bin), sorted: best fit
            bins: list[list] = []
            for length, doc, start in own:
                at = bisect_left(gaps, (length, -1))
                room, b = gaps.pop(at) if at < len(gaps) else (t, len(bins))
                if b == len(bins):
                    bins.append([])
                bins[b].append((doc, start, length))
                if room > length:
                    insort(gaps, (room - length, b))
            for room, b in sorted(gaps, key=lambda g: g[1]):
                packed_room = room
                while packed_room and shorter:
                    # the longest shorter piece that fits, else a cut of the shortest
                    at = bisect_left(shorter, (packed_room + 1, -1, -1)) - 1
                    length, doc, start = shorter.pop(max(at, 0))
                    use = min(length, packed_room)
                    bins[b].append((doc, start, use))
                    packed_room -= use
                    if use < length:
                        insort(shorter, (length - use, doc, start + use))
            packed += [(t, b) for b in bins]
            # pieces cut above may now belong to a shorter tier still
            if t != self.tiers[0]:
                nxt = self.tiers[self.tiers.index(t) - 1]
                low = self.tiers[self.tiers.index(nxt) - 1] if nxt != self.tiers[0] else 0
                tiers[nxt] = sorted((r for r in shorter if r[0] > low), key=lambda r: (-r[0], r[1], r[2]))
        return out + [b for _, b in packed]

    @staticmethod
    def _take(shorter: list, r: tuple) -> bool:
        at = bisect_left(shorter, r)
        if at < len(shorter) and shorter[at] == r:
            shorter.pop(at)
            return True
        return False


def padded(length: int, top: int) -> int:
    """A power of two stands as it is; anything else is padded to the longest tier."""
    return length if length & (length - 1) == 0 else top


def steps(lengths: list[int], budget: int = STEP) -> list[int]:
    """A step group for each sequence: longest first to the group with the fewest tokens, with as many groups as the tokens need."""
    n = max(1, -(-sum(lengths) // budget))
    heap, group = [(0, g) for g in range(n)], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        total, g = heapq.heappop(heap)
        group[i] = g
        heapq.heappush(heap, (total + lengths[i], g))
    return group


def _pack(tiers: tuple[int, ...], vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer, top = tokenizer(vocabulary), Packer(tiers), tiers[-1]
        first = TaskContext.get().partitionId() << 40
        done = groups = 0
        held: list[tuple[int | None, np.ndarray, int, int, int]] = []  # doc_id, ids, start of the ids, doc_tokens

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, done, groups
            sequences = packer.windows([(i, 0, len(h[1])) for i, h in enumerate(held)])
            sums = [sum(p[2] for p in s) for s in sequences]
            keep = [] if last else [s for s, n in zip(sequences, sums, strict=True) if n & (n - 1)]
            sequences = sequences if last else [s for s, n in zip(sequences, sums, strict=True) if not n & (n - 1)]
            sums = [sum(p[2] for p in s) for s in sequences]
            if last:  # what would be padded is cut into powers of two if that costs less
                sequences, sums = _binary(sequences, sums, top)
            step = steps([padded(n, top) for n in sums])
            cols: list[list] = [[] for _ in range(9)]
            for k, (s, n) in enumerate(zip(sequences, sums, strict=True)):
                at = 0
                for i, start, length in s:
                    doc, ids, base, total = held[i]
                    row = (doc, base + start, ids[start : start + length].tobytes(), total, first + done + k, at, n, padded(n, top), first + groups + step[k])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at += length
            done += len(sequences)
            groups += max(step, default=-1) + 1
            held = [(held[i][0], held[i][1][start : start + length].copy(), held[i][2] + start, held[i][3]) for s in keep for i, start, length in s]
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        tokens = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                held.append((doc, ids, 0, len(ids)))
                tokens += len(ids)
                if tokens >= RUN:
                    yield flush(False)
                    tokens = sum(len(h[1]) for h in held)
        if held:
            yield flush(True)

    return run


def _binary(sequences: list, sums: list[int], top: int) -> tuple[list, list[int]]:
    """The last, part-filled sequences of a task: runs whose lengths are the binary digits of their total, so none is padded."""
    full = [s for s, n in zip(sequences, sums, strict=True) if not n & (n - 1)]
    rest = [p for s, n in zip(sequences, sums, strict=True) if n & (n - 1) for p in s]
    left = sum(p[2] for p in rest)
    rest.reverse()
    while left:
        size = min(top, 1 << (left.bit_length() - 1))
        own, room = [], size
        while room:
            doc, start, length = rest.pop()
            use = min(room, length)
            own.append((doc, start, use))
            room -= use
            if use < length:
                rest.append((doc, start + use, length - use))
        full.append(own)
        left -= size
    return full, [sum(p[2] for p in s) for s in full]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all sequences: SCHEMA. ids are the piece's token ids, little-endian, 4 bytes each; tier is the padded length."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pack(tuple(tiers), vocabulary), SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """The pieces with their ids' length and CRC-32 in place of the ids."""
    length = (F.octet_length("ids") / 4).cast("bigint")
    return pack(docs).select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "tier", "step_group")
