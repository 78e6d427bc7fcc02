"""The page tree, sections, the splitter and the crawl, rule by rule on small fixtures."""

import random
from collections import deque
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import functions as F

from kgraph.operators import chunking as S
from kgraph.operators import crawl as K
from kgraph.operators import page_tree as T
from kgraph.operators import pages as P
from kgraph.sources.ordering import numbered, running_total

LONG = "a paragraph of more than twenty letters"


def test_title_headings_and_text_nodes():
    p = T.parsed("<html><head><title> A &amp;\n B </title></head><body><h1>One<b>two</b> three</h1><h3></h3><H2>Next&nbsp;one</H2></body></html>")
    assert p["title"] == "A & B"
    assert p["headings"] == [{"level": "h1", "text": "One two three"}, {"level": "h2", "text": "Next one"}]


def test_noise_goes_with_its_subtree_but_its_links_stay():
    page = f'<body><nav><ul><li><nav>in</nav>an item of the navigation bar<a href="/n">x</a></ul></nav><div class="big sidebar"><p>{LONG} one</p></div><div class="sidebars"><p>{LONG}</p></div><script>var p = "<p>{LONG} no</p>";</script></body>'
    p = T.parsed(page, "http://h/")
    assert p["paragraphs"] == [LONG] and p["list_items"] == [] and p["links"] == ["http://h/n"]


def test_paragraphs_with_attributes_and_without_end_tags():
    p = T.parsed(f'<body><p class="lead">{LONG} 1<p id=x>{LONG} 2<div>no paragraph, though long</div><p>short</p><ul><li><p>{LONG} 3</ul></body>')
    assert p["paragraphs"] == [f"{LONG} {i}" for i in (1, 2, 3)]
    assert [b["type"] for b in p["blocks"]] == ["paragraph", "paragraph", "list", "paragraph"]  # a p in an item counts twice
    assert p["blocks"][2]["items"] == [f"{LONG} 3"]


def test_list_items_over_fifteen_letters_and_direct_children():
    p = T.parsed("<body><ol><li>short<li>sixteen letters x<ul><li>an inner item, long</ul></ol></body>")
    assert p["list_items"] == ["sixteen letters x an inner item, long", "an inner item, long"]
    assert [b["items"] for b in p["blocks"]] == [["sixteen letters x an inner item, long"], ["an inner item, long"]]


def test_tables_and_nested_tables():
    p = T.parsed("<body><table><tr><th>a<th>b</tr><tr><td>1<td><table><tr><td>x</table><td>2</table><table></table></body>")
    assert p["tables"][0] == {"headers": ["a", "b"], "rows": [["1", "x", "x", "2"], ["x"]]}
    assert p["tables"][1] == {"headers": ["x"], "rows": []} and len(p["tables"]) == 2


def test_root_is_main_then_article_then_body():
    inner = f"<article><p>{LONG} in</p></article><p>{LONG} out</p>"
    for page, want in ((f"<body><main>{inner}</main><p>{LONG} far</p></body>", ["in", "out"]), (f"<body>{inner}</body>", ["in"]), (f"<body><p>{LONG} out</p></body>", ["out"]), (f"<p>{LONG} bare</p>", ["bare"])):
        assert [b["text"].split()[-1] for b in T.parsed(page)["blocks"]] == want


def test_links_of_all_forms():
    p = T.parsed("<link href='/no'><a HREF='/x'>1</a><a href=/y>2</a><a href=\" ../../../z \">3</a><a href='#f'>4</a><a>5</a><a href='//o/p?q'>6</a><a href='/x'>7</a>", "https://h/a/b?c")
    assert p["links"] == ["https://h/x", "https://h/y", "https://h/z", "https://h/a/b?c#f", "https://o/p?q"]


def test_trees_links_and_content_gate_in_spark(spark):
    rows = [(1, "http://www.A.org/x/y", f"<p>{LONG}<a href='z.pdf'>a</a><a href='Z#t'>b</a><a href='http://b.org/'>c</a><a href='mailto:x@y'>d</a>"), (2, "http://a.org", None), (3, None, "<div>none</div>")]
    t = T.page_trees(spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("title", F.lit("clash")))
    assert sorted(r.page_id for r in T.with_content(t).collect()) == [1]
    assert {r.link for r in T.page_links(t).collect()} == {"https://a.org/x/Z", "https://b.org/"}
    assert {r.link for r in T.page_links(t, ["a.org"], "/x").collect()} == {"https://a.org/x/Z"}
    assert T.page_trees(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_joined_url_equals_the_standard(spark):
    base = ["http://h/a/b/c?q", "https://h", "http://h/", "http://h/a/"]
    links = ["../../../../../../x", "x", "./x/./y", "../..", "..", "/a/../../b", "?p=/../x", "#f", "//o/p", "http://z/q", "a/b/../../../../../c#../d", "x/."]
    rows = [(b, x) for b in base for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", P.joined_url(F.col("b"), F.col("x")).alias("u")).collect()
    assert {(r.b, r.x): r.u for r in got} == {(b, x): urljoin(b, x) for b, x in rows}


def test_collapse_knows_unicode_spaces(spark):
    from kgraph.functions.text import collapse

    text = " a  \n b　\u0085c "
    assert spark.createDataFrame([(text,)], "t string").select(collapse("t")).first()[0] == "a b c"


def test_split_text_follows_the_separators():
    assert S.split_text("") == [] and S.split_text(" a ") == ["a"]
    assert S.split_text("First line.\n\nSecond part. It goes on; more!", 20, 0) == ["First line.", "Second part", ". It goes on; more!"]
    # merged parts: a separator begins the part behind it; overlap takes whole parts alone
    assert S.split_text("aa bb cc dd ee", 8, 3) == ["aa bb cc", "cc dd", "dd ee"]
    assert S.split_text("aa bb cc dd ee", 9, 0) == ["aa bb cc", "dd ee"]
    # the strongest separator first, the weaker only in parts that are too long
    assert S.split_text("aaaa\n\nbb bb bb bb\n\ncc", 8, 0) == ["aaaa", "bb bb", "bb bb", "cc"]
    # no separator left: letter by letter
    assert S.split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


def test_split_text_keeps_its_promises():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(f"{rng.choice(['w', 'x', 'longer-word-'])}{i}{rng.choice([' ', '. ', chr(10), chr(10) * 2, ', ', '', ''])}" for i in range(rng.randint(0, 300)))
        pieces = S.split_text(text, 90, 20)
        assert all(0 < len(p) <= 90 for p in pieces)
        at = 0
        for p in pieces:  # in order, each beginning at most the overlap before the last one's end
            found = text.find(p, max(0, at - 20))
            assert found >= 0 and not text[at:found].strip()
            at = max(at, found + len(p))
        assert not text[at:].strip()
    long = "x" * 1_000_000
    assert all(len(p) == 1100 for p in S.split_text(long)[:-1])


def test_sections_flush_before_and_after_tables(spark):
    page = f"<body><p>{LONG} 1</p><h1>dropped</h1><p>{LONG} 2</p><h2>Duration</h2><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td> </td></tr></table><p>{LONG} 3</p><h3>Fees</h3><ul><li>the first item of two</li><li>the second item of two</li></ul><p>{LONG} 4</p><h2>Empty</h2><h4>x</h4></body>"
    runs = S.section_runs(T.ordered_blocks(T.page_trees(spark.createDataFrame([(1, "", page), (2, "", None)], "page_id long, url string, html string"))))
    got = [(r.section, r.content_type, r.text) for r in runs.orderBy("page_id", "run").collect()]
    assert got == [
        ("General", "text", f"{LONG} 1\n{LONG} 2"), ("General", "table", "k | v\n1"), ("General", "text", f"{LONG} 3"),
        ("Fees", "text", f"- the first item of two\n- the second item of two\n{LONG} 4"),
    ]
    chunks = S.page_chunks(T.ordered_blocks(T.page_trees(spark.createDataFrame([(1, "", page)], "page_id long, url string, html string"))), 60, 10).orderBy("run", "piece").collect()
    assert all(len(c.content) <= 60 or c.content_type == "table" for c in chunks) and [c.section for c in chunks][-1] == "Fees"


def test_crawl_equals_a_queue(spark):
    rng = random.Random(3)
    urls = [f"u{i:03}" for i in range(80)]
    links = sorted({(rng.choice(urls), rng.choice(urls)) for _ in range(160)})
    blocked = set(rng.sample(urls[5:], 8))
    df = spark.createDataFrame(links, "url string, link string")
    for budget in (1, 3, 10, 200):
        near = {}
        for a, b in links:
            near.setdefault(a, []).append(b)
        queue, visited = deque(["u004", "u001"]), []
        while queue and len(visited) < budget:
            u = queue.popleft()
            if u not in visited:
                visited.append(u)
                queue.extend(x for x in sorted(near.get(u, [])) if u not in blocked and x not in visited)
        got = K.crawl(df, ["u004", "u001"], budget, spark.createDataFrame([(u,) for u in sorted(blocked)], "url string"))
        assert [r.url for r in got.orderBy("visit").collect()] == visited


def test_numbers_over_ranges(spark):
    rng = random.Random(1)
    rows = rng.sample(range(10_000), 3000)
    df = spark.createDataFrame([(x, x % 7) for x in rows], "x long, v int").repartition(5)
    assert [r.n for r in numbered(df, "n", "x").orderBy("x").collect()] == list(range(1, 3001))
    total = 0
    for r in running_total(df, F.col("v"), "t", "x").orderBy("x").collect():
        assert r.t == total
        total += r.v


def test_references_without_a_semicolon():
    page = "<h1>A &amp&amp; B &ltx &copy; &nosuch; &#65 &#66; &amp"
    assert T.parsed(page)["headings"][0]["text"] == "A && B <x © &nosuch; A B &"
    assert T.parsed(page, closed=True)["headings"][0]["text"] == "A &amp& B &ltx © &nosuch; &#65 B &amp"


def test_batches_are_parsed_and_split_in_pieces(monkeypatch):
    seen = []
    kept = T.parsed
    monkeypatch.setattr(T, "parsed", lambda *a: seen.append(a) or kept(*a))
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "url": [None] * 1000, "html": [f"<h1>t{i}</h1>" for i in range(1000)]})
    out = T.parsed_batches([batch], [], [], False)
    first = next(out)
    assert len(seen) == first.num_rows == T.PIECE
    assert [h[0]["text"] for b in (first, *out) for h in b.column("headings").to_pylist()] == [f"t{i}" for i in range(1000)]
    texts = [None, "", *(f"{i} " * 700 for i in range(300))]
    assert S.split_array(pa.array(texts)).to_pylist() == [S.split_text(t) if t else [] for t in texts]


def test_crawl_makes_its_links_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(6)], "url string, link string").mapInArrow(count, "url string, link string")
    assert K.crawl(links, ["p0"]).count() == 7 and made.value == 6
