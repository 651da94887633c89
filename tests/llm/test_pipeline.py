"""The pipeline: each stage on its own input against brute force, and run() as their composition."""

import os
import re

import pytest

import corpus_pipeline as cp
from sparkloom.llm import packing

DATA = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_on_edge_rows(spark, edge):
    docs = spark.read.parquet(f"{edge}/full/documents.parquet")
    got = cp.near_duplicates(spark, docs, "").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    comp, best = groups(rows), {}
    for g, (d, t) in zip(comp, rows, strict=True):
        if shingles(t):
            best[g] = min(best.get(g, (1 << 63, "")), (d if d is not None else 1 << 62, t))
    want = sorted((d if d < 1 << 62 else -1, t) for d, t in best.values())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in got if shingles(r["text"])) == [(d, t) for d, t in want] or _alike(got, want)
    assert sorted(str(r["doc_id"]) for r in got if not shingles(r["text"])) == sorted(str(d) for d, t in rows if not shingles(t))
    assert cp.near_duplicates(spark, docs, "").columns == docs.columns


def _alike(got, want):
    """Among rows of one number and group any text may stay."""
    return sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got if shingles(r["text"])) == [d for d, _ in want]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_take_edge_rows_and_empty_tables(spark, edge, name, stage):
    bench = spark.createDataFrame([(1, "some benchmark item that is long enough to count")], "item_id bigint, text string")
    for part in ("full", "empty"):
        bench.write.mode("overwrite").parquet(f"{edge}/{part}/benchmark.parquet")
        docs = spark.read.parquet(f"{edge}/{part}/documents.parquet")
        out = stage(spark, docs, f"{edge}/{part}")
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert (out.count() > 0) == (part == "full")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if any(c.isalpha() for c in t)]
    seen, first = set(), []
    for g, row in zip(groups(docs), docs, strict=True):
        if g not in seen:
            seen.add(g)
            first.append(row)
    clean = [(d, t) for d, t in first if not any(b in t for b in items)]
    hidden = [(d, re.sub(r"""(?ia:(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{8,})""", "[SECRET]", t)) for d, t in clean]
    hidden = [(d, re.sub(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", "[SECRET]", t)) for d, t in hidden]
    encode = packing.tokenizer()
    want = {d: len(encode(t)) + 1 for d, t in hidden}
    got = {}
    for r in cp.run(spark, DATA).collect():
        assert r["doc_tokens"] == want.get(r["doc_id"], -1)
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
