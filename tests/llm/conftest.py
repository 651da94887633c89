import math

import pytest

WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls in any column, empty and long texts, ties, repeated rows and repeated numbers."""
    base = text(1, 80)
    near = " ".join(base.split()[:70] + ["x"] * 3 + base.split()[73:])
    return [
        (10, base, "en", "a"), (11, base, "en", "a"), (11, base, "en", "a"), (3, near, "en", None), (3, text(2, 60), None, "b"), (None, base, "en", "a"), (None, text(3, 40), None, None), (1, None, "en", "a"), (2, "", "en", "a"), (4, " \n\t ", "de", "b"), (5, "one", "de", "b"), (6, "one", "de", "b"),
        (7, "a b c d", "de", "b"), (8, "A b C d", "de", "b"), (9, "äöü ßßß x é\x0bq", "de", "b"), (12, "the same line\nthe same line\n\nthe same line", "fr", "c"), (13, "$$$ a### b&&& <c> " * 30, "fr", "c"), (14, text(4, 30_000), "en", "c"), (15, text(4, 30_000) + " " + base, "en", "c"), (16, "w" * 50_000, "en", "c"),
        *((100 + i, text(5, 30) + f" only{i} " + text(6, 30), "en", "hot") for i in range(60)), *((200 + i, base, "en", "hot") for i in range(40)), *((300 + i, text(300 + i, 70), ("en", "de")[i % 2], "many") for i in range(60)),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, score double, node string, tag string, component_id bigint, blob string, start int, keep boolean"


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder with tables of such rows, with further columns whose names clash; and one with empty tables."""
    d = tmp_path_factory.mktemp("edge")
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 1, 0.5, "n", "t", 7, "b", 3, False) for r in edge_rows()], SCHEMA)
    docs.repartition(5).write.parquet(f"{d}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{d}/empty/documents.parquet")
    return d


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def ask(sql: str, **tables: str) -> list[dict]:
        c = duckdb.connect()
        for name, path in tables.items():
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        return [dict(zip(names, x, strict=True)) for x in r.fetchall()]

    return ask


def same(rows, want) -> None:
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    canonical = lambda rs: sorted((sorted((k, plain(v)) for k, v in r.items()) for r in rs), key=repr)
    a, b = canonical([r.asDict() if hasattr(r, "asDict") else r for r in rows]), canonical(want)
    assert len(a) == len(b)
    assert a == b


def linked(rows) -> list[dict]:
    """The n-gram join by its definition: every pair of rows (doc_id, text) compared."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [{"doc_id": d, "n_shingles": len(s), "component_id": least.get(find(i)) if s else d} for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
