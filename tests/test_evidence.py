"""Retrieval, rerank selection, questions and cleaning on small graphs, worked out by hand."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from kgraph.functions.text import match_key
from kgraph.operators import cleaning as C
from kgraph.operators import graph as G
from kgraph.operators import paths as W
from kgraph.operators import questions as B
from kgraph.operators import retrieval as R
from kgraph.sources.adjacency import BROADCAST, Front, laid_out, lay_out
from kgraph.sources.json_tables import read_json, write_json

NODES = [("c1", "Northern College", "College"), ("d1", "Department of Physics", "Department"), ("d2", "Department of History", "Department"), ("p1", "Dr. Ada Byron", "Person"), ("t1", "Springfield", "City"), ("s1", "Oregon", "State"), ("x", "", "Blank")]
EDGES = [("c1", "HAS_DEPARTMENT", "d1"), ("c1", "HAS_DEPARTMENT", "d2"), ("p1", "WORKS_AT", "d1"), ("c1", "LOCATED_IN", "t1"), ("t1", "LOCATED_IN", "s1"), ("c1", "RELATED_TO", "c1"), ("c1", "LOCATED_IN", "x"), ("p1", "WORKS_AT", "d2")]
CHUNKS = [
    (1, "The address of Northern College: the campus is located in Springfield, Oregon.", "Contact", "Address", "http://n/contact"),
    (2, "The address of Northern College: the campus is located in Springfield Oregon.", "Contact two", "Address", "http://n/other"),
    (3, "Physics research and publications.", "Research", None, "http://n/research"), (4, " ", "Blank", None, "http://n/blank"),
]


@pytest.fixture(scope="module")
def world(spark):
    nodes = spark.createDataFrame(NODES, "id string, name string, type string")
    edges = spark.createDataFrame([*EDGES, EDGES[0]], "source string, relation string, target string")
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, content string, page_title string, section string, source_url string")
    return nodes, edges, chunks


def test_layout_and_plain_edges_agree(spark, world):
    nodes, edges, _ = world
    g = laid_out(spark, lay_out(nodes, edges))
    seeds = spark.createDataFrame([("c1",), ("p1",)], "id string")
    for direction in ("both", "in", "out"):
        a, b = (sorted(map(tuple, G.expand(e, seeds, 3, direction).collect())) for e in (g.edges, edges))
        assert a == b
    assert sorted(map(tuple, G.neighbours(g.edges, g.nodes, seeds).collect())) == sorted(map(tuple, G.neighbours(edges.distinct(), nodes, seeds).collect()))
    assert {r.id: r.hops for r in G.distances(g.edges, seeds.where("id = 'p1'"), 9).collect()} == {"p1": 0, "d1": 1, "d2": 1, "c1": 2, "t1": 3, "x": 3, "s1": 4}
    assert sorted(r.id for r in G.degrees(g.edges).where("degree = 6").collect()) == ["c1"]
    # few seeds prune the scan, and no shuffle of the edges is planned
    plan = g.edges.leaving(Front(seeds))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(source, [c1,p1])]" in plan and "Exchange" not in plan
    # a large frontier is shuffled into the edges' buckets
    front = Front(g.nodes)
    front.few, front.n = None, BROADCAST + 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = front.of(g.edges.by_source, "source")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 1 and "Bucketed: true" in plan


def test_fetched_edges_in_order_and_strict_relations(spark, world):
    nodes, edges, _ = world
    got = G.fetched(edges.distinct(), nodes, spark.createDataFrame([("c1",)], "id string"), ["HAS_DEPARTMENT"], "out", 1).collect()
    assert [(r.target, r.target_name) for r in got] == [("d1", "Department of Physics")]
    names = spark.createDataFrame([("has part",), (" has_part",), (None,)], "r string")
    assert [r[0] for r in names.select(G.valid_relation(F.col("r"))).collect()] == [None, "HAS_PART", None]
    with pytest.raises(Exception, match="no relation type: has part"):
        names.where("r = 'has part'").select(G.valid_relation(F.col("r"), strict=True)).collect()


def test_path_by_names(world):
    nodes, edges, _ = world
    rows = W.path_query(nodes, edges, "dr ada byron", "Oregon").orderBy("step").collect()
    assert [(r.source_name, r.relation, r.forward) for r in rows] == [("Dr. Ada Byron", "WORKS_AT", True), ("Department of Physics", "HAS_DEPARTMENT", False), ("Northern College", "LOCATED_IN", True), ("Springfield", "LOCATED_IN", True)]
    assert W.path_query(nodes, edges, "dr ada byron", "nobody at all").collect() == []


def test_select_chunks_gates_caps_and_near_duplicates(spark):
    rows = [(1, "q", "a", 0.9, 0.9, ["x", "y"]), (2, "q", "a", 0.8, 0.9, ["u"]), (3, "q", "a", 0.7, 0.9, ["v"]), (4, "q", "b", 0.65, 0.9, ["x", "y"]), (5, "q", "b", 0.6, 0.9, ["w"]), (6, "q", "c", 0.4, 0.9, ["z"]), (7, "r", "a", 0.29, 0.1, ["x"]), (8, "q", "d", 0.54, 0.9, ["k"])]
    scored = spark.createDataFrame(rows, "chunk_id long, q string, page_title string, relevance double, vector double, own array<string>")
    got = {(r.chunk_id, r.strong) for r in R.select_chunks(scored, "q", 5, 2).collect()}
    # 3: third of its page; 4: the same words as 1; 6: under 0.58 of the best; 7: under 0.30
    assert got == {(1, True), (2, True), (5, True), (8, False)}


def test_hybrid_and_rag_evidence(world):
    nodes, edges, chunks = world
    got = R.hybrid(nodes, edges, chunks, "Northern College", {"LOCATED_IN": 9}, 1)
    assert [r.id for r in got["entities"].collect()] == ["c1"]
    assert [(r.relation, r.target) for r in got["relationships"].collect()] == [("LOCATED_IN", "t1"), ("LOCATED_IN", "x"), ("HAS_DEPARTMENT", "d1"), ("HAS_DEPARTMENT", "d2"), ("RELATED_TO", "c1")]
    assert [r.chunk_id for r in got["chunks"].collect()] == [1]
    rag = R.rag_edges(nodes, edges, "springfield", 1, 1).select("source", "relation", "target").collect()
    assert sorted(map(tuple, rag)) == [("c1", "LOCATED_IN", "t1"), ("t1", "LOCATED_IN", "s1")]


def test_term_tiers(spark, world):
    nodes, _, _ = world
    more = nodes.unionByName(spark.createDataFrame([("e1", "Colleges", "X"), ("e2", "The Old Northern College Hall", "X"), ("e3", "northern  college", "X"), ("e4", "N. C.", "X")], "id string, name string, type string"))
    terms = spark.createDataFrame([("Northern College",), ("college",), ("N C",), ("the old northern college hall of fame",), ("zzz",), (" ",)], "term string")
    aliases = spark.createDataFrame([(1, "Northern College"), (1, "N C")], "group_id int, name string")
    got = {}
    for r in B.term_seeds(more, terms, aliases, keep=9, floor=40).collect():
        got.setdefault(r.term, []).append((r.place, r.id, r.score))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["Northern College"] == [(1, "c1", 100.0), (2, "e3", 95.0), (3, "e4", 88.0)]
    assert got["college"] == [(1, "c1", 69.0), (2, "e3", 69.0)]  # "Colleges" has 50 and the hall 51, under the best by more than 12
    assert got["N C"][0] == (1, "e4", 95.0) and {x[1] for x in got["N C"]} == {"e4", "c1", "e3"}
    assert [x[1] for x in got["the old northern college hall of fame"]][0] in ("c1", "e2") and "zzz" not in got
    near = B.term_seeds(more, spark.createDataFrame([("college",)], "term string"), keep=9, encode=R.hashed_vectors).collect()
    assert all(r.score >= 57 for r in near) and max(r.score for r in near) > 69


def test_whole_question_path(spark, world):
    nodes, edges, chunks = world
    asked = [(1, "Where is Northern College?"), (2, "How is Ada Byron related to the History department?"), (3, "zzz qqq"), (4, "List all departments of Northern College"), (5, "What are the fees of Springfield")]
    q = spark.createDataFrame(asked, "question_id long, question string")
    said = []
    out = {r.question_id: r for r in B.answers(q, nodes, edges, chunks).collect()}
    one = out[1].context
    assert "QUERY TYPE: location" in one and "- Northern College [College]" in one
    assert "- [STRONG] Northern College [College] --LOCATED_IN--> Springfield [City]" in one and "HAS_DEPARTMENT" not in one and " [Blank]" not in one
    assert "CHAINED RELATIONSHIPS:\n- [STRONG] Springfield [City] --LOCATED_IN--> Oregon [State]" in one
    assert "DOCUMENT CHUNK 1\nPage: Contact\n" in one and "DOCUMENT CHUNK 2" not in one and "- Contact: http://n/contact" in one  # a near copy goes
    two = out[2].context
    assert "QUERY TYPE: relationship" in two and "PATHS:\n- (1 edges) Dr. Ada Byron [Person] --WORKS_AT--> Department of" in two
    assert not out[3].enough and out[3].answer == B.MESSAGE
    assert "(complete list requested)" in out[4].context and "Department of History" in out[4].context
    # no target types for fees: neighbours by any relation, as support
    assert "[SUPPORTING] Northern College [College] --LOCATED_IN--> Springfield [City]" in out[5].context and "NOTE" not in out[5].context
    told = {r.question_id: r.answer for r in B.answers(q, nodes, edges, chunks, generate=lambda question, context: f"So: {question}").collect()}
    assert told[1] == "So: Where is Northern College?\n\nSources:\n- Contact: http://n/contact" and told[3] == B.MESSAGE and not said
    assert B.answers(q.limit(0), nodes, edges, chunks).collect() == []


def test_questions_of_one_text_are_answered_once(spark, world, tmp_path):
    nodes, edges, chunks = world
    q = spark.createDataFrame([(i, "Where is Northern College?") for i in range(6)] + [(6, "zzz qqq"), (7, "zzz qqq"), (8, None)], "question_id long, question string")

    def generate(question, context):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write("x")
        return context

    out = {r.question_id: (r.enough, r.answer) for r in B.answers(q, nodes, edges, chunks, generate=generate).collect()}
    assert len(out) == 9 and len({out[i] for i in range(6)}) == 1 and out[0][0] and out[0][1].startswith("QUESTION: Where is Northern College?")
    assert {out[i] for i in (6, 7, 8)} == {(False, B.MESSAGE)}
    assert (tmp_path / "calls").read_text() == "x"


def test_fallback_and_large_groups(spark):
    nodes = spark.createDataFrame([("h", "Harbour", "Place"), *((f"b{i}", f"Boat {i}", "Boat") for i in range(9))], "id string, name string, type string")
    edges = spark.createDataFrame([*((f"b{i}", "MOORED_AT", "h") for i in range(9)), ("h", "OWNS", "b1"), ("b2", "LOCATED_NEAR", "b3")], "source string, relation string, target string")
    asked = B.understood(spark.createDataFrame([(1, "Where is the harbour located"), (2, "About the harbour")], "question_id long, question string"), edges)
    seeds = B.question_seeds(asked, nodes)
    rows = B.question_edges(asked, seeds, nodes, edges).collect()
    by = {k: [(r.source, r.relation, r.fallback, r.strong) for r in sorted(rows, key=lambda r: r.place) if r.question_id == k] for k in (1, 2)}
    assert by[1] == [("b0", "MOORED_AT", True, False), ("b1", "MOORED_AT", True, False), ("b2", "MOORED_AT", True, False), ("h", "OWNS", True, False)]
    assert [x[2] for x in by[2]] == [False] * 4
    wide = spark.createDataFrame([(1, i, f"b{i}", f"Boat {i}", "Boat", "MOORED_AT", "h", "Harbour", "Place", 1, 1.0, True, False) for i in range(5)], "question_id long, place int, source string, source_name string, source_type string, relation string, target string, target_name string, target_type string, hop int, score double, strong boolean, fallback boolean")
    lines = [r.line for r in B.edge_lines(wide, seeds.where("question_id = 1")).collect()]
    assert lines == ["- [STRONG] (5 items): Boat 0 [Boat]; Boat 1 [Boat]; Boat 2 [Boat]; Boat 3 [Boat]; Boat 4 [Boat] --MOORED_AT--> Harbour [Place]"]


def test_cleaning_report_counts(spark):
    mentions = spark.createDataFrame([("Ada", "Person", 1), (" ada ", "Person", 2), ("Physics", "Dept", 3), ("", "Person", 4), ("Ghost", None, 5)], "name string, type string, ord long")
    rel = spark.createDataFrame([("Ada", "WORKS_IN", "Physics", 1), ("ADA", "WORKS_IN ", "physics", 2), ("Ada", "LIVES_IN", "Rome", 3), ("Ada", "KNOWS", "Bob", 4), (None, "KNOWS", "Bob", 5), ("Eve", "", "Bob", 6)], "source string, relation string, target string, ord long")
    g = C.clean_graph(mentions, rel, {("LIVES_IN", "target"): "City"}, {"Dept": "Department"}, {"WORKS_IN": "WORKS_AT"})
    got = {r.metric: r.value for r in g.report.collect()}
    assert got == {
        "raw_mentions": 3, "mentioned_nodes": 2, "duplicate_mentions": 1, "type_changes": 1, "raw_relationships": 6, "invalid_relationships": 2, "relation_changes": 2,
        "unique_nodes": 4, "inferred_nodes": 1, "unknown_nodes": 1, "unique_edges": 3, "used_relationships": 4, "duplicate_relationships": 1,
    }
    assert sorted((r.name, r.type) for r in g.nodes.collect()) == [("Ada", "Person"), ("Bob", "Unknown"), ("Physics", "Department"), ("Rome", "City")]


def test_match_key_with_aliases(spark):
    rows = spark.createDataFrame([("N.I.T.",), ("Northern Institute",), ("other",)], "name string")
    assert [r[0] for r in rows.select(match_key(F.col("name"), {"nit": "Northern Institute"})).collect()] == ["northerninstitute", "northerninstitute", "other"]


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert sorted(r.a for r in read_json(spark, str(tmp_path / "lines.json"), "a long", lines=True).collect()) == [1, 2, 3]
    df = spark.range(50).repartition(3)
    write_json(df, f"{tmp_path}/array")
    assert sorted(r.id for r in read_json(spark, f"{tmp_path}/array", "id long").collect()) == list(range(50))
    write_json(df.limit(0), f"{tmp_path}/none")
    assert read_json(spark, f"{tmp_path}/none", "id long").collect() == []


def test_seeded_plans_read_few_relations(spark):
    from kgraph.plans.queries import queries

    for name in ("one_hop_neighbors", "two_hop_expand", "path_lengths", "entity_paths", "rag_context", "edge_scores_two_hops", "priority_relationships"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") < 20 and "lineitem" not in plan, name


def test_texts_whose_signed_counts_cancel_are_indexed(spark):
    # the tokens of "w0 w206" lie in one slot with opposite signs
    rows = spark.createDataFrame([(1, "w0 w206"), (2, "w0"), (3, " ... "), (4, "W0, w206!"), (5, None)], "chunk_id int, content string")
    got = {r.chunk_id: r.vector for r in R.vector_index(rows).collect()}
    assert sorted(got) == [1, 2, 4] and got[1] == got[4]
    assert all(len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6 for v in got.values())


def test_near_duplicates_are_all_pairs_and_meet_by_rare_tokens(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 5, 30]))] for _ in range(25)]
    texts = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        texts.append((i, " ".join(["the", "of", *words]) if i % 2 else " ".join(words), i % 2))
    rows = [*texts, (200, None, 0), (201, "...", 0)]
    own = {i: (set(t.split()), bucket) for i, t, bucket in texts}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, (x, g) in own.items() for b, (y, h) in own.items() if a < b and g == h and len(x & y) / len(x | y) >= 0.8}
    df = spark.createDataFrame(rows, "chunk_id int, content string, bucket int")
    for common in (100_000, 10):
        monkeypatch.setattr(R, "COMMON", common)
        got = [(r.a, r.b, r.score) for r in R.near_duplicates(df, 0.8).collect()]
        assert len(got) == len(want) > 40 and {(a, b): s for a, b, s in got} == want
    # texts that share frequent words alone don't meet
    frequent = " ".join(f"f{i}" for i in range(20))
    many = [(i, f"{frequent} " + " ".join(f"x{i}y{j}" for j in range(10)), 0) for i in range(120)]
    monkeypatch.setattr(R, "COMMON", 100_000)
    seen = []
    kept = DataFrame.distinct
    monkeypatch.setattr(DataFrame, "distinct", lambda df: seen.append(df.count()) or kept(df))
    assert R.near_duplicates(spark.createDataFrame(many, "chunk_id int, content string, bucket int"), 0.8).count() == 0
    assert seen == [0]


def test_selection_drops_rows_before_they_meet(spark):
    rows = spark.range(500).selectExpr("id % 2 AS question", "id AS chunk_id", "concat('p', id) AS page_title", "id / 500D AS relevance", "0.5D AS vector", "array(cast(id AS string)) AS own")
    out = R.select_chunks(rows, "question", 5, 2)
    assert sorted(r.chunk_id for r in out.collect()) == list(range(490, 500))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_near_duplicates_carry_no_text_for_each_pair(spark, monkeypatch):
    """Sets that met but can't be alike are told apart by bitmaps; a set travels to a bin once, not once a pair."""
    rows = [(i, " ".join([*(f"common{j}" for j in range(20)), *(f"own{i}x{j}" for j in range(12)), f"pair{i % 4}"]), 0) for i in range(40)]
    rows += [(100 + i, " ".join(f"same{j}" for j in range(30 + i % 3)), 0) for i in range(60)] + [(7, "a text of its own", 0), (7, "a text with other words", 0), (8, "a text with other words", 0)]
    sent = []
    own = R._binned
    monkeypatch.setattr(R, "_binned", lambda near, sets, *more: sent.append(near.count()) or own(near, sets, *more))
    got = {(r.a, r.b): r.score for r in R.near_duplicates(spark.createDataFrame(rows, "chunk_id int, content string, bucket int"), 0.8).collect()}
    want = {(100 + i, 100 + j): round((30 + min(i % 3, j % 3)) / (30 + max(i % 3, j % 3)), 6) for i in range(60) for j in range(i + 1, 60)}
    assert got == want | {(7, 8): 1.0}
    assert len(sent) == 2 and sent[1] == 3  # the three sets of the sixty, each with each
    a, b = R._mapped(3, (0b1011).to_bytes(8, "little")), R._mapped(40, ((1 << 64 | 1 << 65) | 0b100).to_bytes(16, "little"))
    assert R._bound(a, b) == R._bound(b, a) == (2, 43)


def test_texts_are_encoded_without_meeting(spark):
    rows = [(1, "Alpha beta, alpha!"), (2, "..."), (3, None), (4, "K9 K9 xéy"), (5, "beta alpha")]
    got = R.hashed_vectors(spark.createDataFrame(rows, "id int, content string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == [("id", "int"), ("vector", "array<float>")]
    vectors = {r.id: r.vector for r in got.collect()}
    assert sorted(vectors) == [1, 4, 5] and vectors[1] == vectors[5]
    # tokens k9, x and y
    slots = spark.createDataFrame([("k9",), ("x",), ("y",)], "t string").selectExpr("pmod(xxhash64(t), 64) AS s", "IF(xxhash64(t) < 0, -1, 1) AS n").collect()
    want = [0.0] * 64
    for r in slots:
        want[r.s] += r.n / 3**0.5
    assert max(abs(a - b) for a, b in zip(vectors[4], want, strict=True)) < 1e-6


def test_rows_below_what_is_reached_are_not_put_in_order(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    queries, rows = rng.normal(size=(20, 8)), rng.normal(size=(300, 8))
    seen = []
    own = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *more, **how: seen.append(len(x)) or own(x, *more, **how))
    floor = np.full(20, -np.inf)
    R.best_rows(pa.array(np.arange(300)), rows, queries, floor, 5)
    assert seen == [20] and np.allclose(floor, np.sort(queries @ rows.T, 1)[:, -5])
    had = floor.copy()
    q, r, _ = R.best_rows(pa.array(np.arange(300)), rows / 10, queries, floor, 5)
    assert seen == [20] and (floor == had).all() and not len(q)


def test_vectors_of_all_kinds_over_several_blocks(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4 if i % 5 else 3)]) for i in range(120)] + [(200, [float("nan")] * 4), (201, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 3 = 0 AND vec_id < 200")
    one, many = (sorted(str(tuple(r)) for r in R.nearest(df, asked, 4, most).collect()) for most in (1000, 7))  # as texts, as nan is not itself
    assert one == many and len(one) == 160
