import json
import math
from pathlib import Path

import pytest
from compare import connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanefold.functions import metrics, text
from lanefold.operators import chunking, evaluation, filters, graph, retrieval, significance, verification
from lanefold.plans import planner
from lanefold.sources import loaders


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def lane_rows(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, vector_rank int, graph_rank int, bm25_rank int")


def test_rank_fusion_formula_and_bonus(spark):
    rows = lane_rows(spark, [("q", "c1", 1, 1, None), ("q", "c2", 2, None, None), ("q", "c3", None, 2, None), ("q", "c4", None, None, None)])
    fused = {r["chunk_id"]: (r["rrf"], r["method"]) for r in retrieval.rrf(rows, retrieval._weights(1.0, 1.0, 1.0), F.lit(1.2)).collect()}
    assert fused["c1"] == (pytest.approx(3.2 / 61, abs=1e-9), "hybrid")
    assert fused["c2"] == (pytest.approx(1 / 62, abs=1e-9), "vector") and fused["c3"][1] == "graph"
    assert "c4" not in fused
    off = retrieval.rrf(rows, retrieval._weights(1.0, 0.0, 1.0), F.lit(1.2)).collect()
    assert {r["chunk_id"] for r in off} == {"c1", "c2"} and all(r["method"] == "vector" for r in off)


def test_answer_metrics(spark):
    cases = [("The Paris!", "paris", True, 1.0), ("no", "no", True, 1.0), ("I don't know.", "no", False, 0.0), ("It is New York City", "New York", True, None), (None, "x", False, 0.0), ("x", None, False, 0.0)]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "p string, g string")
    out = df.select(metrics.exact_match(F.col("p"), F.col("g")), metrics.token_f1(F.col("p"), F.col("g"))).collect()
    for (_, _, em, f1), row in zip(cases, out):
        assert row[0] == em
        if f1 is not None:
            assert row[1] == f1


def test_ranking_metrics_edges(spark):
    df = spark.createDataFrame([([1, 2, 3], [3]), ([], [1]), ([1], [])], "r array<bigint>, g array<bigint>")
    out = df.select(metrics.recall_at(F.col("r"), F.col("g"), 2), metrics.ndcg_at(F.col("r"), F.col("g"), 3), metrics.reciprocal_rank(F.col("r"), F.col("g"))).collect()
    assert tuple(out[0]) == (0.0, pytest.approx(1 / math.log2(4)), pytest.approx(1 / 3))
    assert tuple(out[1]) == (0.0, 0.0, 0.0) and tuple(out[2]) == (0.0, 0.0, 0.0)


def test_canonical_forms(spark):
    names = ["Marie Curie (chemist)", "Dr. Albert Einstein", "Curie's", "Straße ", None, "Ann Lee, PhD."]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.canonical_form(text.nfkc("n"))).collect()]
    assert got == ["marie curie", "albert einstein", "curie", "strasse", "", "ann lee"]


def test_normal_names(spark):
    rows = [("The Hague", "GPE"), ("Acme Inc.", "ORGANIZATION"), ("Bob.", "PERSON"), ("The Who", "ORGANIZATION"), ("Rome,;", "GPE")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, t string").select(text.normal_name(F.col("n"), F.col("t"))).collect()]
    assert got == ["Hague", "Acme Inc.", "Bob", "The Who", "Rome"]


def test_lexical_topk_on_small_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "blue fox"), (3, None), (4, ""), (5, "red red red")], "id int, text string")
    q = spark.createDataFrame([(1, "red fox"), (2, None), (3, "the of")], "qid int, q string")
    out = retrieval.bm25_topk(q, docs, "qid", "q", "id", "text").collect()
    assert {r["query_id"] for r in out} <= {1} and (not out or max(r["score"] for r in out) == 1.0)
    assert retrieval.bm25_topk(q, docs.limit(0), "qid", "q", "id", "text").count() == 0


def test_dense_topk_with_blocks_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None)], "id long, v array<double>")
    got = retrieval.dense_topk(v, v, "id", "id", "v", k=2).collect()
    assert len(got) == 12 and all(r["similarity"] == 1.0 and r["query_id"] == r["doc_id"] for r in got if r["rank"] == 1)


@settings(max_examples=30, deadline=None, derandomize=True)
@given(st.lists(st.text(alphabet="ab .", min_size=5, max_size=60), max_size=12))
def test_windows_cover_all_kept_sentences(parts):
    items = list(enumerate(parts))
    out = chunking.windows_of(items, 3, 1, 1, 10_000)
    assert {i for a, z, _, _ in out for i in range(a, z + 1)} == {i for i, _ in items}
    assert all(t for _, _, t, _ in out)


def test_window_extends_short_and_cuts_long_windows():
    assert [x[:2] for x in chunking.windows_of([(0, "a" * 10), (1, "b" * 10), (2, "c" * 10), (3, "d" * 40)], 3, 1, 40, 2000)] == [(0, 3), (2, 3)]
    assert chunking.windows_of([(0, "a" * 90), (1, "b" * 90)], 3, 1, 50, 100)[0][:2] == (0, 0)


def test_fixed_recursive_and_semantic_pieces():
    body = "word " * 600
    pieces = chunking.fixed_pieces(body)
    assert pieces[0][0] == 0 and all(len(p) <= 1024 for _, _, p in pieces) and pieces[-1][1] >= len(body) - 50
    assert chunking.fixed_pieces("  ") == []
    assert all(len(p) <= 1024 for p in chunking.recursive_pieces("para one.\n\n" + body))
    assert "".join(chunking.recursive_pieces("x" * 3000, 1000, 0)) == "x" * 3000
    long = ("Sentence here. " * 60 + "\n\n") * 3
    assert chunking.boundaries(long)[0] == 0 and chunking.boundaries(long)[-1] == len(long)
    assert chunking.boundaries("") == [0]


def test_quality_reasons():
    assert chunking.quality("short")[0] == "too_short"
    assert chunking.quality("a" * 120)[0] == "too_few_words"
    assert chunking.quality("same " * 40)[0] == "low_diversity"
    assert chunking.quality(" ".join(f"word{i}" for i in range(40)))[0] == "passed"


def test_headers_run_on_and_reset():
    out = chunking.headed(["1. Opening words\ntext", "1.2 Details here\nmore", "plain", "2. Second part\nx"])
    assert out[1][0]["chapter"] == "1. Opening words" and out[1][0]["section"] == "1.2 Details here" and out[1][1] == 2
    assert out[2][0]["section"] == "1.2 Details here" and out[3][0]["section"] is None


LISTS = "query_id string, rank int, chunk_id string, text string, score double"


def kept(filtered):
    return sorted((r["query_id"], r["rank"]) for r in filtered.collect())


def test_contradictions(spark):
    years = [("y", 1, "a", "Someone was born in the year 1000.", 0.9), ("y", 2, "b", "Someone was born in the year 3000.", 0.4)]
    counts = [("c", 1, "a", "Population 1000 versus target.", 0.5), ("c", 2, "b", "Population 3000 versus target.", 0.5)]
    small = [("s", 1, "a", "They won 3 to 1", 0.9), ("s", 2, "b", "They won 3 to 1", 0.4)]
    dates = [("d", 1, "a", "7 November 1867 a day", 0.9), ("d", 2, "b", "7 November 1918 a day", 0.4), ("e", 1, "a", "", 0.1)]
    df = spark.createDataFrame(years + counts + small + dates, LISTS)
    assert kept(filters.without_contradicting(df)) == [("c", 1), ("d", 1), ("d", 2), ("e", 1), ("s", 1), ("s", 2), ("y", 1)]
    assert filters.without_contradicting(df.limit(0)).count() == 0


def test_redundancy_is_judged_against_kept_rows_only(spark):
    t = [f"w{i}" for i in range(20)]
    rows = [("q", 1, "a", " ".join(t), 1.0), ("q", 2, "b", " ".join(t[1:] + ["x"]), 0.9), ("q", 3, "c", " ".join(t[3:] + ["x", "y", "z"]), 0.8), ("q", 4, "d", " ".join(t), 0.7), ("p", 1, "a", "", 0.5), ("p", 2, "b", "", 0.4)]
    df = spark.createDataFrame(rows, LISTS)
    assert kept(filters.without_redundant(df)) == [("p", 1), ("p", 2), ("q", 1), ("q", 3)]
    assert kept(filters.relevant(df)) == [("p", 1), ("p", 2), ("q", 1), ("q", 2), ("q", 3), ("q", 4)]


def test_tiers_keep_the_best_and_at_least_five(spark):
    rows = [("q", i, f"c{i}", t, 1 / i) for i, t in enumerate(["nothing", "none", "about Otto Vane", "Vane alone", "the Quillfeather mill", "bridge over the river", "x", "y"], 1)]
    asked = spark.createDataFrame([("q", "Which bridge crosses the river at Quillfeather?", ["Otto Vane", "Quillfeather"])], "query_id string, question string, entities array<string>")
    got = [(r["rank"], r["tier"]) for r in filters.tiered(spark.createDataFrame(rows, LISTS), asked).orderBy("place").collect()]
    assert got == [(3, 0), (5, 0), (6, 1), (1, 2), (2, 2)]


def test_context_folds(spark):
    t = "First part here. Paris is named here. Last part of it all, which goes on for a while."
    assert one(spark, filters.shrunk(F.col("t"), F.array(F.lit("Paris")), 40), t=t).startswith("Paris")
    assert one(spark, filters.truncated(F.col("t"), filters.question_words(F.lit("Where is Paris?")), 45), t=t) == "First part here. Paris is named here."
    assert one(spark, filters.truncated(F.col("t"), filters.question_words(F.lit("Where is Paris?")), 10), t=t) == t[:10]
    assert one(spark, filters.shrunk(F.col("t"), F.array(F.lit("x")), 800), t="short") == "short"
    rows = spark.createDataFrame([("q", 1, "a", "blue", 1.0), ("q", 2, "b", "a red fox", 0.5)], LISTS)
    asked = spark.createDataFrame([("q", "red fox")], "query_id string, question string")
    assert [r["chunk_id"] for r in filters.reordered(rows, asked).orderBy("place").collect()] == ["b", "a"]


def test_graph_support_redirect_and_traversal(spark):
    edges = spark.createDataFrame([("A", "cooccurs", "B", 1.0, 1), ("A", "founded by", "B", 0.5, 1), ("B", "wrote", "C", 0.5, 1)], "src string, relation_type string, dst string, confidence double, n_chunks long")
    ce = spark.createDataFrame([("c1", "A"), ("c1", "B"), ("c2", "A"), ("c2", "B"), ("c3", "B"), ("c3", "C"), ("c4", "H")], "chunk_id string, entity_id string")
    conf = {(r["src"], r["relation_type"]): r["triple_confidence"] for r in graph.with_support(edges, ce).collect()}
    assert conf["A", "founded by"] == pytest.approx(0.477121) and conf["A", "cooccurs"] == pytest.approx(0.25 * 0.477121, abs=1e-6) and conf["B", "wrote"] == pytest.approx(0.6 * 0.30103, abs=1e-6)
    nodes = spark.createDataFrame([(x,) for x in "ABCH"], "entity_id string")
    assert [r[0] for r in graph.isolated(nodes, edges).collect()] == ["H"]
    hops = {r["entity_id"]: r["hops"] for r in graph.bfs(nodes.where("entity_id = 'A'"), edges, 2).collect()}
    assert hops == {"A": 0, "B": 1, "C": 2}
    keep = spark.createDataFrame([("B", "A"), ("A", "A")], "entity_id string, keeper string")
    assert {(r["src"], r["dst"]) for r in graph.redirect(edges, keep).collect()} == {("A", "C")}


def test_substring_lookup_loses_nothing(spark):
    names = spark.createDataFrame([("New York City",), ("York",), ("Yo",), ("Old Yorkshire Mill",), (None,)], "name string")
    keys = spark.createDataFrame([("York",), ("zz",), ("New York City Hall",)], "key string")
    assert {(r["key"], r["name"]) for r in graph.containing(keys, names).collect()} == {("York", "New York City"), ("York", "York"), ("York", "Old Yorkshire Mill")}
    found = {(r["key"], r["name"], r["stage"]) for r in graph.lookup(keys, names.where("name is not null")).collect()}
    assert ("York", "York", 0) in found and ("New York City Hall", "New York City", 2) in found and len(found) == 2


def test_planning(spark):
    rows = [
        ("1", "Are Rome and Oslo both capitals?"), ("2", "Who is it and another singer that won?"), ("3", "Which is older, Amber House or Birch House?"), ("4", None), ("5", "Name it"),
        ("6", "Were Ada Marsh and Otto Vane of the same nationality?"), ("7", "Who directed the film that starred Ada Marsh?"), ("8", "What is the mother of the director of the film?"),
        ("9", "Is Birch Hill taller than Amber Peak in summer?"), ("10", "What did he do that was formed by them?"),
    ]
    q = spark.createDataFrame(rows, "id string, question string")
    p = {r["query_id"]: r for r in planner.planned(q, "id", "question").collect()}
    asks = lambda i: [h["sub_query"] for h in p[i]["hops"]]
    assert p["1"]["pattern"] == "I_boolean_conjunction" and asks("1") == ["Is Rome capitals?", "Is Oslo capitals?"]
    assert p["2"]["query_type"] == "multi_hop" and p["2"]["hops"][1]["depends_on"] == [0]
    assert p["3"]["pattern"] == "select_between_two" and asks("3") == ["When was Amber House born?", "When was Birch House born?"] and p["3"]["direction"] == "greater"
    assert p["4"]["query_type"] == "single_hop" and p["5"]["strategy"] == "vector_only"
    assert p["6"]["pattern"] == "comparison_attr_map" and asks("6") == ["What is the nationality of Ada Marsh?", "What is the nationality of Otto Vane?"]
    assert p["7"]["pattern"] == "connector_split" and asks("7") == ["starred Ada Marsh?", "What is directed Ada Marsh?"] and [h["is_bridge"] for h in p["7"]["hops"]] == [True, False]
    assert p["9"]["pattern"] == "comparison_parallel" and asks("9") == ["Is Birch Hill in summer?", "Is Amber Peak in summer?"]
    assert p["8"]["pattern"].startswith(("fallback", "connector")) and p["10"]["pattern"] in ("connector_split", "fallback_degraded_to_single_hop")


def test_question_names_are_rejoined_and_kept_once(spark):
    rows = [("1", "Did Tower of London open before the Bank of England?"), ("2", 'Who wrote "red fox" and "Red Fox" in 1999?'), ("3", None), ("4", "Is Ada taller than Marshfield?")]
    got = {r["query_id"]: [(e["text"], e["label"]) for e in r["named"]] for r in planner.question_names(spark.createDataFrame(rows, "id string, question string"), "id", "question").collect()}
    assert got["1"] == [("Tower of London", "PROPN"), ("Bank of England", "PROPN")] or [t for t, _ in got["1"]][-1].endswith("England")
    assert got["2"] == [("red fox", "QUOTED"), ("1999", "DATE")] and got["3"] == [] and got["4"] == [("Marshfield", "PROPN")]


def test_cached_scores_at_a_tie_are_those_of_the_statement(spark, sf, tmp_path):
    for f in Path(sf).glob("*.parquet"):
        if f.stem != "retrieval_results":
            (tmp_path / f.name).symlink_to(f)
    made = "SELECT * REPLACE (5 AS vector_rank, 9 AS graph_rank, 4 AS bm25_rank) FROM retrieval_results"
    connect(sf).execute(f"COPY ({made}) TO '{tmp_path}/retrieval_results.parquet' (FORMAT parquet)")
    keys = ["query_id", "pos"]
    got = verification.w33_retrieval_cache(spark, str(tmp_path)).select(*keys, "score").toPandas()
    want = connect(tmp_path).execute(f"SELECT query_id, pos, score FROM ({verification.ORACLE['w33_retrieval_cache']})").df()
    assert len(want) and got.sort_values(keys).values.tolist() == want.sort_values(keys).values.tolist()


def test_verification_columns(spark):
    assert one(spark, verification.final_answer(F.col("a")), a="Step 1\nFINAL ANSWER: Oslo\nmore") == "Oslo"
    assert one(spark, verification.final_answer(F.col("a")), a="x\n\nlast ") == "last"
    assert one(spark, verification.hypothesis(F.col("q"), F.col("a")), q="Who wrote it?", a="Ann.") == "Ann wrote it"
    rows = spark.createDataFrame([("q", 1, "a", "Oslo has 10 parks"), ("q", 2, "b", "Oslo has 90 parks"), ("q", 3, "c", "no value")], "query_id string, rank int, chunk_id string, text string")
    found = verification.conflicts(rows)
    assert [(r["a"], r["b"]) for r in found.collect()] == [("a", "b")]
    assert [r["chunk_id"] for r in verification.without_conflicts(rows, found).collect()] == ["c"]


def test_holm_step_down(spark):
    t = spark.createDataFrame([("a", 0.01, "m"), ("b", 0.04, "m"), ("c", 0.03, "m"), ("d", 0.04, "o")], "name string, p double, family string")
    assert {r["name"]: r["p_adjusted"] for r in significance.holm(t, "p", "name", "family").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06, "d": 0.04}


def test_resampling_is_paired_weighted_and_null_safe(spark):
    import numpy as np

    w = significance.weights(np.arange(1, 400) * 7919, np.arange(1, 400) * 104729, 2000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w)[np.triu_indices(399, 1)]).mean() < 0.03
    df = spark.createDataFrame([(f"q{i}", float(i % 2), None if i == 3 else float(i % 2)) for i in range(60)], "question_id string, a double, b double")
    cols = {"a": F.col("a"), "same": F.col("b") - F.col("a"), "none": F.lit(None).cast("double")}
    got = {r["key"]: r for r in significance.paired_bootstrap(df, cols, 3000).collect()}
    assert set(got) == {"a", "same"} and got["same"]["n"] == 59 and got["same"]["delta"] == 0 and got["same"]["p_value"] == 1.0
    assert 0.35 < got["a"]["ci_low"] < 0.42 and 0.58 < got["a"]["ci_high"] < 0.65 and got["a"]["p_value"] < 0.01
    assert significance.bootstrap_ci(df.limit(0), cols, 10).count() == 0


def test_cost_per_query():
    assert evaluation.COST == pytest.approx(0.0034)


def test_document_reader(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "sub" / "b.md").write_text("# head")
    (tmp_path / "c.json").write_text(json.dumps([{"id": "x", "context": [["T", ["s1.", "s2."]], ["bad"]]}, {"_id": "y", "text": "body"}, {"other": 1}]))
    (tmp_path / "d.json").write_text(json.dumps({"content": "one"}))
    (tmp_path / "e.jsonl").write_text('{"passage": "p1"}\nnot json\n\n{"text": "p2"}\n')
    (tmp_path / "f.csv").write_text("skip,me")
    got = {r["text"] for r in loaders.read_documents(spark, str(tmp_path)).collect()}
    assert {"plain text", "# head", "body", "one", "p1", "p2", '{"other":1}'} <= got and any(t.startswith("T s1. s2.") for t in got) and len(got) == 8
    with pytest.raises(FileNotFoundError):
        loaders.read_documents(spark, str(tmp_path / "nowhere"))


def test_question_sets(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text(json.dumps([{"_id": "1", "question": "q", "answer": "a", "type": "bridge", "context": [["T", ["x"]], ["U", ["y"]]], "supporting_facts": [["T", 0]]}, {"_id": "2", "question": "r", "answer": "b", "context": [["T", ["other"]]], "supporting_facts": []}]))
    articles, questions = loaders.paired_context(spark, str(p))
    assert {r["title"]: r["sentences"] for r in articles.collect()} == {"T": ["x"], "U": ["y"]}
    assert questions.where("id = '1'").first()["supporting_facts"][0]["title"] == "T"
    m = tmp_path / "m.jsonl"
    m.write_text(json.dumps({"id": "1", "question": "q", "answer": "a", "paragraphs": [{"idx": 0, "title": "A", "paragraph_text": "t", "is_supporting": True}, {"idx": 1, "title": "B", "paragraph_text": "u", "is_supporting": False}], "question_decomposition": [{"paragraph_support_idx": 1}]}))
    assert loaders.decomposed(spark, str(m))[1].first()["gold_titles"] == ["B"]
    s = tmp_path / "s.json"
    s.write_text(json.dumps([{"qid": "1", "question": "q", "answer": True, "facts": ["a long enough fact", "short"]}]))
    facts, q = loaders.yes_no_facts(spark, str(s))
    assert facts.count() == 1 and q.first()["answer"] == "yes"


def test_exports_and_stores(spark, tmp_path):
    x = tmp_path / "x.json"
    x.write_text(json.dumps({"metadata": {}, "results": [{"chunk_id": "c", "entities": [{"entity_id": "e", "name": "N"}], "relations": []}]}))
    assert loaders.read_extractions(spark, str(x)).first()["entities"][0]["name"] == "N"
    r = tmp_path / "r.jsonl"
    r.write_text('{"question_id": "1", "f1_score": 0.5}\nbroken\n')
    assert loaders.read_records(spark, str(r)).count() == 1 and loaders.read_records(spark, str(tmp_path / "none")).count() == 0
    v = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "id string, v array<float>")
    store = str(tmp_path / "vec")
    assert loaders.write_vectors(v, store, "v") == 2
    with pytest.raises(ValueError):
        loaders.write_vectors(spark.createDataFrame([("b", [1.0])], "id string, v array<float>"), store, "v")
    assert {tuple(round(y, 2) for y in row["v"]) for row in spark.read.parquet(store).collect()} == {(0.6, 0.8), (0.0, 0.0)}
    t = str(tmp_path / "ent")
    for seq, name in ((1, "old"), (2, "new")):
        loaders.upsert(spark, spark.createDataFrame([("e", name, seq)], "id string, name string, seq int"), t, ["id"], "seq")
    assert [row["name"] for row in loaders.read_table(spark, t).collect()] == ["new"]
    with pytest.raises(RuntimeError):
        with loaders.Transaction(spark) as tx:
            tx.upsert(spark.createDataFrame([("e", "broken", 3), ("f", "x", 1)], "id string, name string, seq int"), t, ["id"], "seq")
            raise RuntimeError
    assert [row["name"] for row in loaders.read_table(spark, t).collect()] == ["new"] and loaders.read_table(spark, str(tmp_path / "no")) is None
    with pytest.raises(KeyError):
        loaders.Transaction(spark).nodes("Planet", spark.range(1), t, "id")
    assert json.loads(loaders.get_text(spark, store + "/_meta.json")) == {"dim": 2, "metric": "cosine", "count": 2}
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert loaders.stage(spark, str(tmp_path / "st"), build).count() == 3 == loaders.stage(spark, str(tmp_path / "st"), build).count() and len(calls) == 1
    assert loaders.stage(spark, str(tmp_path / "st"), build, "other").count() == 3 and len(calls) == 2
    (tmp_path / "runs" / "sweep_a_1").mkdir(parents=True)
    assert loaders.latest_run(spark, str(tmp_path), "sweep", "a").endswith("sweep_a_1") and loaders.latest_run(spark, str(tmp_path), "none") is None
    assert r"a\_b" in loaders.latex_table(spark.createDataFrame([("a_b", None)], "x string, y string"))
    assert "| 0 |" in loaders.write_summary(spark.range(1), str(tmp_path / "sum"))
    loaders.clear(spark, t)
    assert not loaders.exists(spark, t)


def test_stream_drops_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    from lanefold.streaming import events

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    src, t = str(tmp_path / "in"), datetime(2025, 1, 1, 12)
    for i, rows in enumerate(([(1, t, 1, "view", 1.0, None)], [(2, t + timedelta(hours=3), 1, "view", 2.0, None)], [(3, t, 1, "view", 9.0, None), (2, t + timedelta(hours=3), 1, "view", 2.0, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = events.unique_events(events.event_stream(spark, src, schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert i < 3
    assert sorted(r["event_id"] for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == [1, 2]


@pytest.mark.parametrize("shuffles", ["1", "5"])
def test_fusion_does_not_depend_on_partitions(spark, sf, shuffles):
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    got = retrieval.r08_rrf_fusion(spark, sf).orderBy("query_id", "rank").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = retrieval.r08_rrf_fusion(spark, sf).orderBy("query_id", "rank").toPandas()
    assert got.equals(want)
