"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set is its distinct SHINGLE-word shingles (as hashes of BITS bits). Two documents link if their sets' Jaccard
similarity is at least 75 %; the result is each document's component. Documents of equal sets are one node, named by a hash
of the set; nodes are what is joined.

Order. A node's shingles are ordered by how many nodes have them, rarest first. Those of one node only come first and can't
match; those that a mapper's task finds in HEAVY nodes at a time come last. A node of n shingles has at least
a = ceil(0.75 n) in common with any partner, so a node with fewer than a repeated shingles has none, and the l first shared
shingles lie in the first n - a + l of either side.

Adaptive prefixes. Each node chooses its l, and with it the length of its prefix, by the estimated cost: the postings of its
prefix, and of their candidates, which must match l times, the verifications. Two nodes are candidates if they share at
least min(l, l') prefix shingles.

Groups of copies. All pairs of a group are never made. A star comes first: each prefix shingle has a centre, each node is
verified against the commonest centre of its shingles, and what links is one component. Then only candidates from different
components are left, for a link within a component adds nothing. All of them are examined, so no link between components is
lost, and there is no cap: pairs that share a shingle of more than FREQUENT nodes are found by counting in blocks of bounded
size, which make no rows of pairs; all others by a join on their rare shingles.

Data flow. Mapper tasks send (shingle, node) pairs as compressed blocks to buckets of shingles, where the number of nodes of
each is counted; what is repeated goes on to buckets of nodes, where prefixes are chosen. A shingle that FLUSH words of a
task show in HEAVY nodes or more is sent once for all of them (its nodes learn of it at home), so a very common passage
doesn't fill its bucket. Nothing is collected; the driver sees counts.

Defined results: a null or empty text, or one without a word, has no set (0) and is its own component; with fewer than
SHINGLE words the whole sequence is the one shingle; rows that repeat a doc_id are documents of their own that share a
number; a null doc_id takes part, and is named as a component only where no document has a number; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release, written
from .graph import components

SHINGLE = 5
#: Of a shingle's hash: of a billion documents, one may count a shingle too few.
BITS = 56
#: The similarity, as a fraction.
OVER, UNDER = 75, 100
#: Words that a task works on together; nodes there from which a shingle counts as heavy; shingles of a partition, the most
#: shuffle partitions, the parts in which one is opened, and pairs that it sends on together.
FLUSH, HEAVY, PARTITION, PARTITIONS, PARTS, TOGETHER = 1_200_000, 32, 4_000_000, 20_000, 4, 1_000_000
#: The most matches asked for; a verification's cost in postings; the order of heavy shingles.
MOST, VERIFY, LAST = 5, 40, (1 << 31) - 1
#: Nodes from which a shingle is frequent in the last step, shingles of a block there, and for how many a node counts besides its own.
FREQUENT, WEIGHT, NODE_WEIGHT = 24, 1_000_000, 50
NO_ID = (1 << 63) - 1
COLUMNS = "doc_id bigint, tag bigint, node bigint, n bigint, u bigint, l int, prefix array<bigint>, shingles array<bigint>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Of each SHINGLE words in a row, given the words' hashes; with fewer words, of the sequence."""
    n, k = len(h), min(SHINGLE, len(h))
    x = np.full(max(n - SHINGLE + 1, 1), k, np.uint64)
    for j in range(k):
        x = _mix(x + np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(x)])
    return x >> np.uint64(64 - BITS)


def place_of(tok: np.ndarray, places: int) -> np.ndarray:
    """The place of each shingle among so many ranges of hashes: in order, and with small differences within."""
    return ((tok >> np.uint64(BITS - 32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)


def planes(a: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte: what they have in common compresses."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(n)


class Blocks:
    """Named columns of unsigned 64-bit numbers as one compressed string; sorted columns as differences."""

    def __init__(self) -> None:
        self.pack, self.unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def dump(self, *columns: tuple[np.ndarray, bool]) -> bytes:
        parts = [np.array([len(c) for c, _ in columns], "<i8").tobytes()]
        parts += [planes(np.diff(c.astype(np.uint64), prepend=np.uint64(0)) if rising else c.astype(np.uint64)) for c, rising in columns]
        return self.pack.compress(b"".join(parts))

    def load(self, block: bytes, *rising: bool) -> list[np.ndarray]:
        raw = self.unpack.decompress(block)
        sizes, at, out = np.frombuffer(raw, "<i8", len(rising)), 8 * len(rising), []
        for n, up in zip(sizes.tolist(), rising, strict=True):
            c = unplanes(raw[at : at + 8 * n], n) if n else np.zeros(0, np.uint64)
            out.append(np.cumsum(c, dtype=np.uint64) if up else c)
            at += 8 * n
        return out


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "block"])


#: Kinds of blocks. DOC: doc_id, null or not, tag, node, n. PAIR: see pairs_out. NODE: node, shingle, order; and node, n.
DOC, PAIR, NODE = 0, 1, 2


def edges_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in x, and its end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def pairs_out(blocks: Blocks, tok: np.ndarray, ref: np.ndarray, names: np.ndarray, top: np.ndarray, places: int) -> Iterator[tuple[int, bytes]]:
    """Pairs (shingle, node) as one block for each partition of shingles: its nodes once, then each of its PARTS by itself.

    tok is sorted, and top (heavy shingles, which come without nodes) too; ref points into names, which are sorted.
    """
    at, top_at = place_of(tok, places * PARTS), place_of(top, places * PARTS)
    for p in np.union1d(at // PARTS, top_at // PARTS).tolist():
        bounds = np.arange(p * PARTS, (p + 1) * PARTS + 1)
        cut, top_cut = np.searchsorted(at, bounds), np.searchsorted(top_at, bounds)
        used, own = np.unique(ref[cut[0] : cut[-1]], return_inverse=True)
        parts = [blocks.dump((names[used], True))]
        for x, y, i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), top_cut[:-1].tolist(), top_cut[1:].tolist(), strict=True):
            parts.append(blocks.dump((tok[x:y], True), (own[x - cut[0] : y - cut[0]], False), (top[i:j], True)) if y > x or j > i else b"")
        yield p, b"".join([np.array([len(b) for b in parts], "<i4").tobytes(), *parts])


def pairs_in(blocks: Blocks, held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles, nodes and heavy shingles of a partition's blocks, part by part."""
    ends = [np.cumsum(np.append(4 * (PARTS + 1), np.frombuffer(b, "<i4", PARTS + 1))) for b in held]
    names = [blocks.load(b[e[0] : e[1]], True)[0] for b, e in zip(held, ends, strict=True)]
    for part in range(1, PARTS + 1):
        tok, own, top = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, e, n in zip(held, ends, names, strict=True):
            if e[part + 1] > e[part]:
                t, ref, heavy = blocks.load(b[e[part] : e[part + 1]], True, False, True)
                tok.append(t)
                own.append(n[ref.astype(np.int64)])
                top.append(heavy)
        yield np.concatenate(tok), np.concatenate(own), np.unique(np.concatenate(top))


def _send(places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, blocks = _Hashes(), Blocks()
        ids: list[int | None] = []
        tags: list[int] = []
        nodes: list[int] = []
        sizes: list[int] = []
        sets: dict[int, np.ndarray] = {}
        words = 0

        def flush() -> pa.RecordBatch:
            rows = []
            place = (len(ids) * 2654435761 + sum(nodes[:3])) % places
            known = np.array([0 if i is None else i for i in ids], np.int64).astype(np.uint64)
            rows.append((DOC, place, blocks.dump((known, False), (np.array([i is not None for i in ids]), False), (np.array(tags, np.int64).astype(np.uint64), False), (np.array(nodes, np.int64).astype(np.uint64), False), (np.array(sizes, np.int64), False))))
            if sets:
                names = np.array(list(sets), np.int64).astype(np.uint64)
                own = list(sets.values())
                turn = np.argsort(names)
                names, own = names[turn], [own[i] for i in turn.tolist()]
                lengths = np.array([len(s) for s in own])
                tok, ref = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), lengths)
                order = np.argsort(tok, kind="stable")
                tok, ref = tok[order], ref[order]
                first = edges_of(tok)
                count = np.diff(first)
                heavy = count >= HEAVY
                shown = np.repeat(heavy, count)
                rows += [(PAIR, p, b) for p, b in pairs_out(blocks, tok[~shown], ref[~shown], names, tok[first[:-1][heavy]], places)]
                # nodes' sizes, and their heavy shingles, go to the nodes' places
                rows += _home(blocks, names[ref[shown]], tok[shown], np.full(int(shown.sum()), LAST), names, lengths, places)
            for x in (ids, tags, nodes, sizes, sets):
                x.clear()
            release()
            return _batch(rows)

        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes().lower().split() if text.is_valid else []
                node = n = 0
                if raw:
                    s = np.unique(shingle_hashes(np.fromiter(map(hashes.__getitem__, raw), np.uint64, len(raw))))
                    node, n = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s)
                    if node not in sets:
                        sets[node] = s
                        words += len(raw)
                ids.append(doc)
                tags.append(tag)
                nodes.append(node)
                sizes.append(n)
                if words >= FLUSH or len(ids) >= 200_000:
                    yield flush()
                    words = 0
        if ids:
            yield flush()
        hashes.clear()
        release()

    return run


def _home(blocks: Blocks, own: np.ndarray, tok: np.ndarray, rank: np.ndarray, names: np.ndarray, lengths: np.ndarray, places: int) -> list[tuple[int, int, bytes]]:
    """NODE blocks for the nodes' places: shingles with their order (own, tok, rank), and sizes (names, lengths)."""
    by, home = (own % np.uint64(places)).astype(np.int64), (names % np.uint64(places)).astype(np.int64)
    turn = np.lexsort((tok, own, by))
    own, tok, rank, by = own[turn], tok[turn], rank[turn], by[turn]
    turn = np.argsort(home, kind="stable")
    names, lengths, home = names[turn], lengths[turn], home[turn]
    rows = []
    for p in np.union1d(by, home).tolist():
        (x, y), (i, j) = np.searchsorted(by, [p, p + 1]), np.searchsorted(home, [p, p + 1])
        rows.append((NODE, p, blocks.dump((own[x:y], True), (tok[x:y], False), (rank[x:y], False), (names[i:j], False), (lengths[i:j], False))))
    return rows


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Blocks of one bucket by kind; they come sorted by bucket."""
    held: dict[int, list[bytes]] = {}
    at = None
    for batch in batches:
        for kind, bucket, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at and held:
                yield at, held
                held = {}
            at = bucket
            held.setdefault(kind, []).append(block)
    if held:
        yield at, held


def repeated(t: np.ndarray, o: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (shingle, node), those whose shingle has two nodes or is among top (heavy), and its order."""
    order = np.argsort(t, kind="stable")
    t, o = t[order], o[order]
    first = edges_of(t)
    keep = np.repeat((np.diff(first) > 1) | np.isin(t[first[:-1]], top), np.diff(first))
    t, o = t[keep], o[keep]
    order = np.lexsort((o, t))  # the same node from two tasks counts once
    t, o = t[order], o[order]
    once = np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))[: len(t)]
    t, o = t[once], o[once]
    first = edges_of(t)
    count = np.diff(first)
    rank = np.repeat(np.where(np.isin(t[first[:-1]], top), LAST, np.minimum(count, LAST - 1)), count)
    return t[rank > 1], o[rank > 1], rank[rank > 1]


def _count(places: int):
    """How many nodes have each shingle of a partition; repeated ones go on to their nodes. Other kinds pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, none = Blocks(), np.zeros(0, np.uint64)
        for bucket, held in _by_bucket(batches):
            yield _batch([(kind, bucket, b) for kind in (DOC, NODE) for b in held.pop(kind, ())])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            pairs = held.pop(PAIR, [])
            for part, (t, o, top) in enumerate(pairs_in(blocks, pairs), 1):
                found.append(repeated(t, o, top))
                if part == PARTS or sum(len(x[0]) for x in found) >= TOGETHER:
                    t, o, rank = (np.concatenate(c) for c in zip(*found, strict=True))
                    found.clear()
                    if len(t):
                        yield _batch(_home(blocks, o, t, rank, none, none, places))
                    del t, o, rank
                    release()
            del held, pairs
            release()

    return run


def choose(ranks: np.ndarray, a: int) -> tuple[int, int]:
    """l and the prefix's length, for a node's repeated shingles' ranks in order, of which a partner has at least a."""
    cost = np.cumsum(np.minimum(ranks, 1 << 24).astype(float))
    best = min(range(1, min(MOST, a) + 1), key=lambda m: (cost[len(ranks) - a + m - 1] * (1 + VERIFY / m**2), m))
    return best, len(ranks) - a + best


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and the nodes that may have a partner, with their prefixes."""
    blocks = Blocks()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for _, held in _by_bucket(batches):
        for b in held.get(DOC, ()):
            doc, known, tag, node, n = (c.astype(np.int64) for c in blocks.load(b, *[False] * 5))
            arrays = [pa.array(doc, mask=known == 0), pa.array(tag), pa.array(node), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(doc), k) for k in kinds[4:])], names=names)
        if NODE not in held:
            continue
        o, t, rank, name, size = (np.concatenate(c) for c in zip(*(blocks.load(b, True, False, False, False, False) for b in held[NODE]), strict=True))
        sizes = dict(zip(name.tolist(), size.tolist(), strict=True))
        order = np.lexsort((t, o))
        o, t, rank = o[order], t[order], rank[order]
        first = np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1])) if len(o) else np.zeros(0, bool)
        if len(o):
            rank = np.maximum.reduceat(rank, np.flatnonzero(first))
        o, t = o[first], t[first]
        edges = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
        rows = []
        for x, y in zip(edges.tolist(), np.append(edges[1:], len(o)).tolist(), strict=True):
            n = sizes[int(o[x])]
            a = -(-OVER * n // UNDER)
            if y - x < a:
                continue
            turn = np.lexsort((t[x:y], rank[x:y]))
            own = t[x:y][turn].astype(np.int64)
            m, length = choose(rank[x:y][turn], a)
            rows.append((None, None, int(o[x].astype(np.int64)), n, n - (y - x), m, own[:length], own))
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        yield out(rows)
        del held, o, t, rank, name, size, sizes, rows
        release()


def tag_of(text: str):
    """What tells rows of one number apart."""
    return F.xxhash64(F.col(text))


def prepare(docs: DataFrame, key: str, text: str) -> DataFrame:
    """COLUMNS: a row for each document (u is null), and for each node that may have a partner (doc_id and more than one column of it)."""
    raw = F.col(text).cast("binary")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    places = max(1, math.ceil(size / 6 / PARTITION))
    parts = min(places, PARTITIONS)
    deal = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket")
    kinds = "kind int, bucket bigint, block binary"
    sent = docs.select(F.col(key).cast("bigint").alias("doc_id"), tag_of(text).alias("tag"), raw.alias("raw")).mapInArrow(_send(places), kinds)
    with batches_of(docs.sparkSession, 64):
        return written(deal(deal(sent).mapInArrow(_count(places), kinds)).mapInArrow(_choose, COLUMNS), "ngram-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. A pair's first set travels to its second's."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb")), "b")
    return two.withColumn("i", F.size(F.array_intersect("sa", "sb"))).filter(F.col("i") * UNDER >= (F.col("na") + F.col("nb") - F.col("i")) * OVER).select("a", "b")


def _compare(df: pd.DataFrame) -> pd.DataFrame:
    """Links between nodes of different components in two blocks of a cluster (or one); for each node, one link to each component.

    Postings of the second block's prefixes count shared prefix shingles; nodes with candidates then get exact intersections
    from the postings of whole sets. Both are arrays of numbers as long as what they count: no pair is a row.
    """
    band, i, j, over = (int(df[c].iloc[0]) for c in ("low", "i", "j", "over"))
    one, two = df[(df["block"] == i) & (df["band"] == band)].reset_index(drop=True), df[(df["block"] == j) & (df["band"] == band + over)].reset_index(drop=True)
    out: list[tuple[int, int]] = []

    def postings(column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = two[column].map(len).to_numpy()
        tok, of = np.concatenate(two[column].tolist()), np.repeat(np.arange(len(two)), lengths)
        order = np.argsort(tok, kind="stable")
        keys, first = np.unique(tok[order], return_index=True)
        return keys, np.append(first, len(tok)), of[order]

    def shared(x: np.ndarray, keys: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        at = at[keys[at] == x]
        parts = [of[a:b] for a, b in zip(first[at].tolist(), first[at + 1].tolist(), strict=True)]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    if len(one) and len(two):
        by_prefix, by_all = postings("prefix"), postings("shingles")
        names, comps, sizes, ls = (two[c].to_numpy() for c in ("node", "comp", "n", "l"))
        for node, comp, n, own_l, prefix, shingles in zip(*(one[c].tolist() for c in ("node", "comp", "n", "l", "prefix", "shingles")), strict=True):
            near, k = shared(np.asarray(prefix), *by_prefix)
            near = near[(k >= np.minimum(ls[near], own_l)) & (comps[near] != comp) & (np.minimum(sizes[near], n) * UNDER >= np.maximum(sizes[near], n) * OVER)]
            if len(near):
                met, both = shared(np.asarray(shingles), *by_all)
                at = np.searchsorted(met, near)  # what shares prefix shingles is among those
                hit = near[both[at] * UNDER >= (sizes[near] + n - both[at]) * OVER]
                _, first = np.unique(comps[hit], return_index=True)
                out += [(node, int(names[h])) for h in hit[first]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _dense(here: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components among nodes that share a frequent prefix shingle.

    Such nodes form clusters (components over those shingles). Nodes that link have sizes that differ by a third at most, so a
    cluster is cut into bands of sizes that grow by a third, and only a band and the next are compared. A band is dealt into
    blocks of about WEIGHT shingles (a node counts for NODE_WEIGHT more), and each pair of blocks is one group: bounded, however large the cluster is.
    """
    spots = written(here.select(F.col("s"), "node", "comp", "n", "l").distinct(), "ngram-dense")
    # a shingle stands for the least of its nodes, so that edges are of nodes
    least = spots.groupBy("s").agg(F.min("node").alias("b"))
    of = written(components(spots.join(least, "s").select(F.col("node").alias("a"), "b")), "ngram-clusters")
    kept = spots.select("node", "comp").distinct().join(of.withColumnRenamed("comp", "cluster"), "node")
    band = F.floor(F.log(F.col("n")) / math.log(UNDER / OVER)).cast("int")
    members = written(sets.join(kept, "node").withColumn("band", band), "ngram-members")
    weight = members.groupBy("cluster", "band").agg(F.ceil(F.sum(F.size("shingles") + NODE_WEIGHT) / WEIGHT).cast("int").alias("blocks"))
    weight = written(weight, "ngram-weights")
    beside = lambda d, name: weight.select("cluster", (F.col("band") + d).alias("band"), F.col("blocks").alias(name))
    weight = written(weight.join(beside(-1, "above"), ["cluster", "band"], "left").join(beside(1, "below"), ["cluster", "band"], "left"), "ngram-weights")
    dealt = members.join(weight, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(0)) - 1)
    some = lambda n, f: F.when(F.col(n) > 0, F.transform(each(n), f)).otherwise(F.array().cast("array<struct<low:int,i:int,j:int,over:int>>"))
    group = lambda low, i, j, over: F.struct(low.cast("int").alias("low"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(over).alias("over"))
    here, block = F.col("band"), F.col("block")
    groups = F.concat(some("blocks", lambda o: group(here, F.least(block, o), F.greatest(block, o), 0)), some("above", lambda o: group(here, block, o, 1)), some("below", lambda o: group(here - 1, o, block, 1)))
    pairs = dealt.withColumn("g", F.explode(groups)).select("cluster", "g.*", "band", "block", "node", "comp", "n", "l", "prefix", "shingles")
    return pairs.groupBy("cluster", "low", "i", "j", "over").applyInPandas(_compare, "a bigint, b bigint")


def _star(posts: DataFrame) -> DataFrame:
    """For each node, the commonest centre of its prefix's shingles; a shingle's centre is its node with the fewest shingles of its own."""
    rank = F.struct(F.floor(F.col("u") * 50 / F.col("n")).alias("own"), "node", "n")
    centre = posts.groupBy("s").agg(F.min(rank).alias("c")).select("s", F.col("c.node").alias("b"), F.col("c.n").alias("b_n"))
    near = posts.join(centre, "s").filter((F.col("node") != F.col("b")) & (F.least("n", "b_n") * UNDER >= F.greatest("n", "b_n") * OVER))
    return near.groupBy("node", "b").agg(F.count("*").alias("k")).groupBy("node").agg(F.max(F.struct("k", "b")).alias("x")).select(F.col("node").alias("a"), F.col("x.b").alias("b"))


def links(nodes: DataFrame) -> DataFrame:
    """node, comp of the nodes that link with another. nodes: node, n, u, l, prefix, shingles."""
    posts = nodes.select(F.explode("prefix").alias("s"), "node", "n", "u", "l")
    shared = posts.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1").select("s")
    posts = written(posts.join(shared, "s"), "ngram-postings")
    sets = written(nodes.join(posts.select("node").distinct(), "node", "left_semi").select("node", "n", "l", "prefix", "shingles"), "ngram-shared")
    stars = written(verified(_star(posts), sets), "ngram-stars")
    comp = components(stars)
    # a shingle of one component can't link any more
    here = posts.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = here.groupBy("s").agg(F.count("*").alias("shown"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("s", "shown")
    here = written(here.join(counts, "s"), "ngram-left")
    # pairs that share a frequent shingle are found in blocks; all others have their matches among rare ones
    rare = here.filter(F.col("shown") <= FREQUENT)
    x, y = rare.alias("x"), rare.alias("y")
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.comp") < F.col("y.comp")) & (F.least("x.n", "y.n") * UNDER >= F.greatest("x.n", "y.n") * OVER))
    pairs = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("k"), F.first(F.least("x.l", "y.l")).alias("need")).filter("k >= need").select("a", "b")
    rest = written(verified(pairs, sets).union(_dense(here.filter(F.col("shown") > FREQUENT), sets)), "ngram-links")
    return components(stars.union(rest))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row; also tag (of its text) and first: whether it is its component's first document."""
    table = prepare(docs, key, text)
    rows, nodes = table.filter("u IS NULL").select("doc_id", "tag", "node", "n"), table.filter("u IS NOT NULL").drop("doc_id", "tag")
    comp = links(nodes)
    name = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("tag").alias("t"))  # rows without a number come last
    least = rows.filter("n > 0").groupBy("node").agg(F.min(name).alias("least"))
    named = least.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = written(named, "ngram-named")
    first = written(named.groupBy("comp").agg(F.min("least").alias("first")), "ngram-first")  # a table of its own: Spark can split a large component in the join
    of = named.select("node", "comp").join(first, "comp").select(F.col("node").alias("of"), "first")
    out = rows.join(of, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("first.d"), F.lit(NO_ID)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "tag", F.coalesce(F.col("first") == name, F.lit(True)).alias("first"))


def digest(docs: DataFrame) -> DataFrame:
    return join(docs).drop("tag", "first")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are their component's first document; of equal rows (by number and text), one. Rows without a word all stay."""
    keep = written(join(docs, key, text).filter("first").select(F.col("doc_id").alias("__d"), F.col("tag").alias("__t"), (F.col("n_shingles") > 0).alias("__set")), "ngram-kept")
    one = keep.distinct()
    kept = docs.withColumn("__tag", tag_of(text)).join(one, F.col(key).cast("bigint").eqNullSafe(F.col("__d")) & (F.col("__tag") == F.col("__t")), "left_semi")
    if keep.filter("__set").groupBy("__d", "__t").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count():
        bare = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")) == ""
        kept = kept.filter(~bare).dropDuplicates([key, "__tag"]).union(kept.filter(bare))
    return kept.drop("__tag")


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, g FROM (SELECT r, doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
met AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM met JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE i * {UNDER} >= (a.n + b.n - i) * {OVER}),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE c.least END AS component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT x, min(v.doc_id) AS least FROM reach JOIN w v ON v.r = reach.y GROUP BY x) c ON c.x = w.r"""
