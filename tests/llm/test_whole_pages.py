"""Main text is whole: what stands beside a long body, and what a few pages of a host don't show."""

import random
import time

import pytest

from sparkloom.llm import extract


def test_titles_beside_long_bodies_stay():
    long = lambda i: " ".join(f"word{i}x{j}" for j in range(600))
    shells = ["<article><h1>Title {i}</h1><div class=body><p>{t}</p></div></article>", "<div class=a><h1>Title {i}</h1><div class=body><p>{t}</p></div></div>", "<main><div class=body><p>{t}</p></div><section><p>End {i}</p></section></main>"]
    for shell in shells:
        pages = [f"<html><body><nav>Menu</nav>{shell.format(i=i, t=long(i))}<footer>Foot {i}</footer></body></html>" for i in range(5)]
        w = extract.induce(pages)
        for i, p in enumerate(pages):
            want = [f"Title {i}", long(i)] if "h1" in shell else [long(i), f"End {i}"]
            assert extract.extract(p, w).split("\n") == want


def test_template_and_place_by_counts_over_all_pages(spark):
    fresh = lambda i, k=3: " ".join(f"word{i}x{j}" for j in range(k))
    rows = []
    for i in range(40):  # most pages carry the banner; three of 40 share a text; one in ten has a lede beside its body
        banner = "<div class=b>Always here</div>" if i % 5 else ""
        shared = "<p>Happens to be shared</p>" if i in (3, 7, 11) else ""
        lede = f"<p>Lede {i}</p>" if i % 10 == 0 else ""
        rows.append((i, "http://a.example/x", f"<body><div class=c>{banner}{lede}<div class=d><p>{fresh(i)}</p>{shared}</div></div></body>"))
    for i in range(40, 52):  # a second layout
        rows.append((i, "http://a.example/y", f"<body><div class=second><div>Second banner</div><p>{fresh(i)}</p></div></body>"))
    for i in range(60, 64):  # pages of more nodes than the alignment takes
        rows.append((i, "http://b.example/", f"<body><div>Top line</div><div class=t>{''.join(f'<p>{i} {j}</p>' for j in range(2000))}</div></body>"))
    rows += [(70 + i, "http://c.example/", "<body><h1>One</h1><p>page many times</p></body>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.main_text(df).collect()}
    for i in range(40):
        assert got[i].split("\n") == [*([f"Lede {i}"] if i % 10 == 0 else []), fresh(i), *(["Happens to be shared"] if i in (3, 7, 11) else [])]
    assert all(got[i] == fresh(i) for i in range(40, 52))
    assert all(got[i].split("\n") == [f"{i} {j}" for j in range(2000)] for i in range(60, 64))
    assert all(got[i] == "One\npage many times" for i in range(70, 79))


def test_menus_and_notices_with_meaningless_names(spark):
    """No article, no class that says anything: the alignment alone tells template from content."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    want, rows = {}, []
    for i in range(30):
        title, paragraphs = fresh(4), [fresh(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        cells = [rng.choice(("yes", "no")) for _ in range(4)]  # common texts in slots that vary are content
        table = "".join(f"<tr><td>{c}</td></tr>" for c in cells)
        notice = "<div class=q7>We use crumbs. <b>Fine</b></div>" if i % 4 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, "http://z.example/p", f"<body><div class=a1><div>Home</div><div>About</div></div>{notice}<div class=b2><h2>{title}</h2>{body}<table>{table}</table></div><div class=c3>Made by us</div></body>"))
        want[i] = [title, *paragraphs, *cells]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in extract.main_text(df).collect()}
    assert got == want
    w = extract.induce([r[2] for r in rows])
    assert all(extract.extract(r[2], w).split("\n") == want[r[0]] != extract.extract(r[2]).split("\n") for r in rows)


def test_names_on_article_text_and_forms_around_pages():
    assert extract.extract("<article><p class='notice'>Keep</p><div class='share-price'>12</div><p id=ad>this</p><div class=ad>Drop</div><div class='ad-slot 3'>Drop</div></article>") == "Keep\n12\nthis"
    assert extract.extract("<body><form><table><tr><td>The page stands in a form</td></tr></table><select><option>x</select></form><div>Foot</div></body>") == "The page stands in a form\nFoot"
    assert extract.extract("<body><article><h1>T</h1><p>x</p><form><label>Your mail, please, for all our letters</label><input></form></article></body>") == "T\nx"
    assert extract.extract("<body><h1>Title</h1><article><p>x</p></article><section class=comments><p>A very long comment of a reader</p></section><div role=navigation>Menu</div></body>") == "Title\nx"
    assert extract.extract("<body><div class='related'>All there is, in an odd place</div></body>") == "All there is, in an odd place"


@pytest.mark.parametrize("n", [600, 5000, 40_000])
def test_deep_and_unclosed_markup(spark, n):
    began = time.time()
    for html in ("<div>" * n + "<p>deep", "<p>a<b>" * n + "deep", "<ul>" + "<li>x" * n + "<li>deep", "<table>" + "<tr><td>x" * n + "<td>deep", "</div></p>" * n + "deep", "<a href='" * 50 + "deep", "<div class='" + "a " * n + "'>deep"):
        assert html.endswith("deep") and extract.extract(html).replace("'", "").endswith("deep") == (not html.startswith("<a"))
    if n <= 5000:
        pages = [(i, "http://deep.example/", "<div>" * n + f"<p>one {i}</p><p>Same</p>") for i in range(4)]
        got = extract.main_text(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in got} == {i: f"one {i}" for i in range(4)}
    assert time.time() - began < 60


def test_the_query_does_what_induce_does(spark):
    """Whole query against the same rules with all pages at hand, on hosts of every size, with copies and two layouts."""
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = []
    for h, n in enumerate((1, 2, 3, 7, 40, 120)):
        for i in range(n):
            layout = "<div class=x><div>Top {h}</div><p>{a}</p><p>Shared end</p></div>" if i % 3 else "<section><ul><li>One<li>Two</ul><div><p>{a}</p><p>{b}</p></div></section>"
            rows.append((len(rows), f"https://h{h}.example/{i}", "<body>" + layout.format(h=h, a=fresh(2), b=fresh(1)) + "</body>"))
    rows += rows[-20:]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(7)
    by: dict = {}
    for _, url, html in rows:
        by.setdefault(url.split("/")[2], []).append(html)
    wrappers = {h: extract.induce(pages) for h, pages in by.items()}
    assert sum(map(bool, wrappers.values())) >= 3
    want = sorted((p, extract.extract(html, wrappers[url.split("/")[2]])) for p, url, html in rows)
    assert sorted((r["page_id"], r["text"]) for r in extract.main_text(df).collect()) == want


def _random_tree(rng: random.Random, shapes: int) -> extract.Tree:
    """A root with many children, most of different shapes."""
    up, name = [-1], [1]
    for _ in range(shapes):
        at = [0]
        for _ in range(rng.randint(3, 9)):
            up.append(rng.choice(at) if len(at) > 1 else 0)
            at.append(len(up) - 1)
            name.append(2 if up[-1] == 0 else rng.choice((3, 4, 5)))
    return extract.Tree(up, name, [rng.randrange(9) for _ in up])


def test_lists_of_many_shapes_are_matched_by_what_is_below_them():
    def largest(a: extract.Tree, i: int, b: extract.Tree, j: int) -> int:
        if a.name[i] != b.name[j]:
            return 0
        row = [0] * (len(b.kids[j]) + 1)
        for x in a.kids[i]:
            above, row = row, [0]
            for n, y in enumerate(b.kids[j]):
                row.append(max(above[n + 1], row[n], above[n] + largest(a, x, b, y)))
        return row[-1] + 1

    rng = random.Random(3)
    for _ in range(2):
        a, b = _random_tree(rng, 110), _random_tree(rng, 120)
        assert len({a.kind[k] for k in a.kids[0]}) * len({b.kind[k] for k in b.kids[0]}) > 4000
        m = extract.Matching()
        assert m.weight(a, 0, b, 0) == largest(a, 0, b, 0) == len(m.pairs(a, b))


@pytest.mark.parametrize("memo", [1_000_000, 2])
def test_halving_long_lists_finds_the_same_matching(monkeypatch, memo):
    rng = random.Random(4)
    monkeypatch.setattr(extract, "MEMO", memo, raising=False)
    for _ in range(40):
        a, b = _random_tree(rng, rng.randint(1, 20)), _random_tree(rng, rng.randint(1, 20))
        want = None
        for cells in (4_000_000, 30, 2):
            monkeypatch.setattr(extract, "CELLS", cells)
            got = sorted(extract.Matching().pairs(a, b))
            want = want or got
            assert got == want


def test_votes_are_the_same_on_any_number_of_tasks(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    rows = [(i, f"https://h{i % 3}.example/{i}", f"<body><div class=x><div>Top</div><p>{fresh(1)}</p>{f'<ul><li>{fresh(1)}</ul>' * (i % 4)}<p>End</p></div></body>") for i in range(150)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 5, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, extract.counts(df).collect())))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2]
