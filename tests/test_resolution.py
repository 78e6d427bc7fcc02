"""Operators whose results SQL can't state, on small fixtures."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from kgraph.operators import cleaning as C
from kgraph.operators import entities as E
from kgraph.operators import pages as P
from kgraph.operators import paths as W
from kgraph.operators import retrieval as R
from kgraph.sources.json_tables import read_json, write_json


def test_links_join_like_urls(spark):
    bases = ["https://a.org", "https://a.org/", "https://a.org/x/y.html", "http://a.org/x/?q=1#f", "https://a.org/x/y/z"]
    links = ["b.html", "/b", "../c", "./d", "?p=2", "#top", "//c.net/e", "https://d.com/f", "mailto:x@y.z", "../../g/../h", "x/./y"]
    rows = [(a, b) for a in bases for b in links]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", P.joined_url(F.col("a"), F.col("b")).alias("u")).collect()
    wrong = [(r.a, r.b, r.u, urljoin(r.a, r.b)) for r in got if r.u.rstrip("/") != urljoin(r.a, r.b).rstrip("/")]
    assert not wrong


def test_skip_and_scope(spark):
    urls = ["https://a.org/x.PDF", "https://a.org/x.pdf?y", "https://a.org/x.html", "https://A.org/in/x", "https://b.org/in/", "not a url", "https://a.org"]
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(P.skipped(F.col("u")), P.in_scope(F.col("u"), ["a.org"], "/in"), P.in_scope(F.col("u"), ["a.org"])).collect()]
    assert got == [(True, False, True), (True, False, True), (False, False, True), (False, True, True), (False, False, False), (False, False, False), (False, False, True)]


def test_paths_of_three_edges(spark):
    rng = random.Random(2)
    rows = sorted({(str(rng.randint(0, 14)), rng.choice("RS"), str(rng.randint(0, 14))) for _ in range(22)})
    edges = spark.createDataFrame(rows, "source string, relation string, target string")
    step: dict = {}
    for a, r, b in rows:
        if a != b:
            step.setdefault((a, b), set()).add(f"{r}>")
            step.setdefault((b, a), set()).add(f"{r}<")
    want = {}
    for s in ("1", "2"):
        for e in ("3", "2", "9"):
            paths = [[s]] if s != e else []
            for _ in range(3):
                paths = [[*p, min(step[p[-1], n]), n] for p in paths for n in sorted({b for a, b in step if a == p[-1]}) if n not in p]
                if done := [p for p in paths if p[-1] == e]:
                    want[s, e] = min(" ".join(p) for p in done)
                    break
    got = {(r.start, r.end): r.path for r in W.entity_paths(edges, ["1", "2"], ["3", "2", "9"], 99).collect()}
    assert got == want and want
    names = spark.createDataFrame([("1", "one", "N")], "id string, name string, type string")
    line = W.rendered(spark.createDataFrame([("1", "5", "1 R> 4 S< 5")], "start string, end string, path string"), names).first().line
    assert line == "one [N] --R--> 4 [?] <--S-- 5 [?]"


def test_cascade_takes_the_first_tier(spark):
    nodes = spark.createDataFrame([("1", "Dr. Jane Smith", "Person"), ("2", "Jane Smith Hall", "Place"), ("3", "Institute of Tests", "Place"), ("4", "Jan Smyth", "Person")], "id string, name string, type string")
    ask = lambda q, **k: sorted((r.id, r.tier) for r in E.search_cascade(nodes, q, **k).collect())
    assert ask("jane smith") == [("1", 2)] and ask("smith") == [("1", 3), ("2", 3)] and ask("smith", kind="place") == [("2", 3)]
    assert ask("IoT", aliases={"iot": "Institute of Tests"}) == [("3", 1)] and ask("jame smithe") == [("1", 4), ("2", 4), ("4", 4)] and ask("zzzz") == []


def test_terms_share_no_seed_and_fall_back(spark):
    nodes = spark.createDataFrame([("1", "red gear", "Part"), ("2", "blue gear", "Part"), ("3", "home", "Place")], "id string, name string, type string")
    ask = lambda terms: sorted((r.term, r.id) for r in E.resolve_terms(nodes, terms, "home").collect())
    assert ask(["red gear", "gear"]) == [("gear", "2"), ("red gear", "1")] and ask(["nothing"]) == [("home", "3")] and ask(["home"]) == [("home", "3")]


def test_json_arrays(spark, tmp_path):
    import json

    df = spark.createDataFrame([(i, None if i % 3 == 0 else f'a "{i}" é\n') for i in range(50)], "id long, x string").repartition(3)
    write_json(df, str(tmp_path / "t"))
    files = [json.loads(p.read_text()) for p in (tmp_path / "t").glob("part-*") if p.read_text().strip()]
    assert sum(map(len, files)) == 50 and all(isinstance(f, list) for f in files)
    assert sorted(read_json(spark, str(tmp_path / "t"), "id long, x string").collect()) == sorted(df.collect())


def test_index_skips_blank_chunks_and_encodes_equal_ones_alike(spark):
    chunks = spark.createDataFrame([(1, "red gear"), (2, " "), (3, None), (4, "red gear"), (5, "blue bolt")], "chunk_id long, content string")
    got = {r.chunk_id: r.vector for r in R.vector_index(chunks).collect()}
    assert sorted(got) == [1, 4, 5] and got[1] == got[4] != got[5]
    assert sum(x * x for x in got[5]) == pytest.approx(1, abs=1e-6)


def test_records_and_texts(spark):
    one = spark.range(1)
    assert one.select(C.comparison_text(F.lit("dept of Arts & Sciences, the dept and more"), {"dept": "department", "and": ""}, ["the"])).first()[0] == "dept of arts sciences department more"
    assert one.select(C.chunk_number(F.lit("page_12_7"), F.lit(3).cast("long")), C.chunk_number(F.lit("page"), F.lit(3).cast("long"))).first()[:] == (7, 3)
    bad = ["[]", "{}", '{"entities": [], "relationships": [{"source": "a", "relation": "", "target": "b"}]}', None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in bad], "x string").select(C.valid_record(F.col("x"))).collect()] == [False] * 4
