"""Operators that SQL can express: rows with every kind of trouble, against DuckDB; empty tables; the laws of sharding."""

import pytest
from conftest import linked, same  # tests/llm/conftest.py

from sparkloom.llm import ngram_join, quality, quotes, sharding
from sparkloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op1_sharding", "op5_substrings", "op7_ngram_join", "op10_quality"])
def test_edge_rows(spark, edge, duck, name):
    same(QUERIES[name](spark, f"{edge}/full").collect(), duck(ORACLE_SQL[name], documents=f"{edge}/full/documents.parquet/*.parquet"))
    assert QUERIES[name](spark, f"{edge}/empty").collect() == []


@pytest.mark.parametrize("frequent, weight", [(1, 500), (2, 3000)])
def test_every_way_through_the_join_gives_the_same(spark, edge, monkeypatch, frequent, weight):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "WEIGHT", weight)
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    monkeypatch.setattr(ngram_join, "PARTITION", 5000)
    monkeypatch.setattr(ngram_join, "FLUSH", 3000)
    rows = spark.read.parquet(f"{edge}/full/documents.parquet").select("doc_id", "text").collect()
    same(QUERIES["op7_ngram_join"](spark, f"{edge}/full").collect(), linked(rows))


def test_small_buckets_and_runs_of_super_k_mers_give_the_same(spark, edge, duck, monkeypatch):
    from sparkloom.llm import substrings

    monkeypatch.setattr(substrings, "PLACE", 60_000)
    monkeypatch.setattr(substrings, "OPEN", 20_000)
    monkeypatch.setattr(substrings, "FLUSH", 20_000)
    monkeypatch.setattr(substrings, "PARTITIONS", 3)
    same(QUERIES["op5_substrings"](spark, f"{edge}/full").collect(), duck(ORACLE_SQL["op5_substrings"], documents=f"{edge}/full/documents.parquet/*.parquet"))


def test_equal_hashes_of_windows_are_told_apart(monkeypatch):
    import numpy as np

    from sparkloom.llm import substrings

    texts = [b"a b c d", b"x a b c", b"a b c"]
    heads = np.array([[3, 0, 7, 0, 0, 0], [2, 0, 7, 10, 0, 0], [1, 0, 7, 20, 0, 0]])
    want = [[2, 0, 7, 11, 14], [3, 0, 7, 0, 3]]
    assert sorted(substrings.repeats(texts, heads, 3).tolist()) == want
    monkeypatch.setattr(substrings, "range_hashes", lambda codes, start, end: np.zeros(len(start), np.uint64))
    assert sorted(substrings.repeats(texts, heads, 3).tolist()) == want


def test_null_numbers_and_the_largest_number_are_not_confused(spark, duck, tmp_path):
    base = " ".join(f"v{i}" for i in range(30))
    rows = [(None, f"n{i} {base} m{i}") for i in range(5)] + [((1 << 63) - 1, f"big {base}"), ((1 << 63) - 1, f"{base} other"), (-(1 << 63), "small " + base), (None, base), (None, base)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["op5_substrings"](spark, str(tmp_path)).collect(), duck(ORACLE_SQL["op5_substrings"], documents=f"{tmp_path}/documents.parquet/*.parquet"))
    only = spark.createDataFrame([(None, f"n{i} {base}") for i in range(3)], "doc_id bigint, text string")
    from sparkloom.llm import substrings

    assert [r["n_removed"] for r in substrings.digest(only).collect()] == [0, 0, 0]


@pytest.mark.parametrize("places", [1, 50, 2500])
def test_blocks_do_not_grow_with_places(places):
    """What a run of words sends to many places is compressed about as well as what it sends to few."""
    import random

    import numpy as np

    from sparkloom.llm import ngram_join as nj

    rng, blocks = random.Random(3), nj.Blocks()
    sets = [np.unique(np.array([rng.getrandbits(nj.BITS) for _ in range(500)], np.uint64)) for _ in range(200)]
    names = np.sort(np.array([rng.getrandbits(64) for _ in sets], np.uint64))
    tok, ref = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(tok)
    sent = list(nj.pairs_out(blocks, tok[order], ref[order], names, tok[:0], places))
    got = [(int(t), int(o)) for _, b in sent for t, o, _ in nj.pairs_in(blocks, [b]) for t, o in zip(t.tolist(), o.tolist(), strict=True)]
    assert got == list(zip(tok[order].tolist(), names[ref[order]].tolist(), strict=True))
    assert sum(len(b) for _, b in sent) / len(tok) < {1: 8, 50: 13, 2500: 30}[places]


def test_a_new_shard_takes_rows_only_to_itself(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    got = sharding.with_shard(df, "k", [1.0] * 10, "shard", "grown").collect()
    moved = [r for r in got if r["shard"] != r["grown"]]
    assert all(r["grown"] == 10 for r in moved) and 0.06 < len(moved) / 4000 < 0.12
    eleven = {r["k"]: r["shard"] for r in sharding.with_shard(df, "k", [1.0] * 11).collect()}
    assert all(eleven[r["k"]] == r["grown"] for r in got)
    sizes = [sum(r["shard"] == s for r in got) for s in range(10)]
    assert min(sizes) > 320 and max(sizes) < 480
    weighted = [r["shard"] for r in sharding.with_shard(df, "k", [1.0, 3.0]).collect()]
    assert 0.70 < sum(weighted) / 4000 < 0.80


def test_slots_are_gapless(spark, edge):
    by: dict = {}
    for r in QUERIES["op1_sharding"](spark, f"{edge}/full").collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_very_many_equal_rows_get_their_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 100)
    df = spark.createDataFrame([(1, "x")] * 950 + [(i, "y") for i in range(50)], "doc_id bigint, text string")
    by: dict = {}
    for r in sharding.assign_slots(df, weights=(1.0,) * 3).collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == 1000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_a_frequent_shingle_in_most_documents(spark):
    """Most documents share one line; some are mostly that line, and link or don't by the rest."""
    rng = __import__("random").Random(8)
    word = lambda: f"u{rng.randrange(10**6)}"
    line = " ".join(f"line{i}" for i in range(40))
    rows = [(i, f"{line} {' '.join(word() for _ in range(rng.choice((2, 5, 12, 60))))}") for i in range(400)] + [(1000 + i, " ".join(word() for _ in range(50))) for i in range(50)]
    same(ngram_join.digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect(), linked(rows))


def test_verdicts_follow_the_habits_of_a_source(spark):
    """The same counts pass where they are usual, and fail where nobody else has them."""
    body = lambda i, n=80: " ".join(f"word{i:04d}x{j:02d}" for j in range(n))
    rows = [(i, f"{body(i)} {'# ' * 20}", "en", "code") for i in range(200)] + [(1000 + i, body(1000 + i), "en", "prose") for i in range(200)]
    rows += [(5000, f"{body(5000)} {'# ' * 20}", "en", "code"), (5001, f"{body(5000)} {'# ' * 20}", "en", "prose"), (5002, f"{body(5000)} {'# ' * 20}", "xx", "rare")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(got[d]["base_failed"] for d in (5000, 5001, 5002)) and len({got[d]["n_symbols"] for d in (5000, 5001)}) == 1
    assert got[5000]["kept"] and not got[5001]["kept"] and got[5002]["kept"]  # the rare group takes the fences of all
    assert all(got[i]["kept"] for i in range(200)) and all(got[1000 + i]["kept"] for i in range(200))


def test_paths_of_negative_turns_and_popular_messages(spark, duck, tmp_path):
    rows = [(1, -5, "a", "start"), (1, -3, "b", "> start\n\nsecond"), (1, 2, "c", "> second\n\nthird"), *((2, 0, "x", "hub") for _ in range(1)), *((2, i, "y", f"> hub\n\nanswer {i}") for i in range(1, 60)), *((2, 100 + i, "z", f"> answer {i}\n\nmore {i}") for i in range(1, 30))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op6_quotes"](spark, str(tmp_path)).collect()
    same(got, duck(quotes.ORACLE_SQL, conversations=f"{tmp_path}/conversations.parquet/*.parquet"))
    assert [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["thread_key"])] == [-5, -3, 2]
    assert {r["depth"] for r in got if r["conv_id"] == 2 and r["turn"] > 100} == {2}


def test_counts_by_their_definition(spark, edge):
    import re

    rows = spark.read.parquet(f"{edge}/full/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count: dict = {}
        for g in tri:
            count[g] = count.get(g, 0) + 1
        covered = {i + j for i, g in enumerate(tri) if count[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append({"doc_id": d, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)})
    same(quality.with_counts(spark.read.parquet(f"{edge}/full/documents.parquet"), "doc_id", "text").collect(), want)


def test_sketches_merge(spark, edge):
    counts = quality.with_counts(spark.read.parquet(f"{edge}/full/documents.parquet"), "doc_id", "text", "lang", "source").cache()
    parts = [quality.sketches(counts.filter(f"coalesce(doc_id, 0) % 3 = {i}")) for i in range(3)]
    merged = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "signal", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    same(merged.collect(), [r.asDict() for r in quality.sketches(counts).collect()])


THREAD = [
    (1, 0, "a", "Hello there.\n\nSecond thought."), (1, 1, "b", "On Monday, a wrote:\n> Hello   THERE.\n\nHi!"), (1, 2, "c", "> Hi!\n>> Hello there.\nMe too"), (1, 3, "a", ">> Hi!\n> Me too\nAgreed"), (1, 4, "d", "> nobody said this\nok"),
    (1, 5, "e", "> Agreed\n> \n> Me too\n\nfine"), (2, 0, "x", "Hello there."), (2, 1, "y", None), (2, 2, "y", ""), (2, 3, "z", ">Hello there."), (2, 3, "z", ">Hello there."), (None, 1, "n", "> Hello there."), (3, None, "n", "lost"), (3, 5, "n", "> lost\nz"), (4, 1, "p", "> self\nself"), (4, 0, "p", "self"),
]


def test_quotes(spark, duck, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in THREAD], "conv_id bigint, turn bigint, role string, text string, depth int, path string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op6_quotes"](spark, str(tmp_path)).collect()
    same(got, duck(quotes.ORACLE_SQL, conversations=f"{tmp_path}/conversations.parquet/*.parquet"))
    of = {(r["conv_id"], r["turn"]): r for r in got}
    assert [of[1, t]["parent_turn"] for t in range(6)] == [None, 0, 1, 2, None, 3]
    assert of[1, 1]["body"] == "Hi!" and of[1, 2]["body"] == "Me too" and of[2, 1]["body"] == ""
    assert (of[1, 2]["n_quoted"], of[1, 2]["n_linked"], of[1, 3]["depth"], of[1, 5]["root_turn"]) == (2, 2, 3, 0)
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["thread_key"])]
    assert order == [0, 1, 2, 3, 5, 4]
    assert of[None, 1]["parent_turn"] is None and of[3, 5]["parent_turn"] is None and of[4, 1]["parent_turn"] == 0
    assert QUERIES["op6_quotes"](spark, _empty(spark, tmp_path, df)).collect() == []


def _empty(spark, tmp_path, df) -> str:
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    return f"{tmp_path}/none"
