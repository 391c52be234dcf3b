import json
import random

import pandas as pd
import pytest

from lanefold.functions import hooks
from lanefold.operators import linking
from lanefold.plans import settings


def test_linking_merges_near_names_of_one_type_only(spark):
    nodes = spark.createDataFrame([("1", "Quillfeather Marine Institute"), ("2", "Quillfeather Marine Institute."), ("3", "Quillfeather Marine Institutes"), ("4", "Other Place"), ("5", None)], "entity_id string, name string").selectExpr("entity_id", "name", "'ORG' AS entity_type", "1.0D AS confidence")
    nodes = nodes.unionByName(spark.createDataFrame([("6", "Quillfeather Marine Institute", "GPE", 1.0)], nodes.schema))
    m = spark.createDataFrame([("c1", "2"), ("c2", "2"), ("c1", "1")], "chunk_id string, entity_id string")
    got = {r["entity_id"]: r["keeper"] for r in linking.linked_entities(nodes, m).collect()}
    assert got == {"1": "2", "2": "2", "3": "2"}


def test_similar_names_match_brute_force(spark):
    from collections import Counter

    rng = random.Random(6)
    words = ["institute", "marine", "research", "north", "film", "aa", "ab"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)]
    names = sorted({n for b in base for n in (b, b + "s", b.replace("m", "n", 1), b[:-1] or "x", b + " " + b)})
    grams = lambda n: Counter(f"^{n}$"[i : i + 3] for i in range(len(n)))
    def cosine(a, b):
        x, y = grams(a), grams(b)
        return sum(x[g] * y[g] for g in x) / (sum(c * c for c in x.values()) * sum(c * c for c in y.values())) ** 0.5
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if round(cosine(a, b), 9) >= 0.92 and min(len(a), len(b)) >= 0.4 * max(len(a), len(b))}
    df = spark.createDataFrame([("ORG", n) for n in names] + [("GPE", names[0])], "entity_type string, canon string")
    got = [(r["a"], r["b"]) for r in linking.similar_names(df).collect()]
    assert len(want) > 30 and sorted(got) == sorted(want)


def test_similar_names_match_brute_force_for_long_and_repetitive_names(spark):
    from collections import Counter

    rng = random.Random(8)
    long = ["".join(rng.choices("abcdefg ", k=k)).strip() for k in (60, 95, 99, 101, 104, 150, 240)]
    names = sorted({n for b in long for n in (b, b[:-2], b[:40] + "x" + b[41:], b + " ab", b[: len(b) // 2])} | {"a" * k for k in (1, 2, 3, 4, 7, 12, 30, 80, 110, 160)} | {"ab" * k for k in (2, 5, 40, 60)} | {"a" * k + "b" for k in (9, 30)})
    grams = {n: Counter(f"^{n}$"[i : i + 3] for i in range(len(n))) for n in names}
    norm = {n: sum(c * c for c in grams[n].values()) for n in names}
    cosine = lambda a, b: sum(grams[a][g] * grams[b][g] for g in grams[a]) / (norm[a] * norm[b]) ** 0.5
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if round(cosine(a, b), 9) >= 0.92 and min(len(a), len(b)) >= 0.4 * max(len(a), len(b))}
    got = [(r["a"], r["b"]) for r in linking.similar_names(spark.createDataFrame([("ORG", n) for n in names], "entity_type string, canon string")).collect()]
    assert any(len(a) <= 100 < len(b) or len(b) <= 100 < len(a) for a, b in want) and len(want) > 30 and sorted(got) == sorted(want)


def test_similar_names_move_little_where_many_names_share_letters(spark):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choices(["ba", "do", "ki", "lu", "me", "no", "ra", "su"], k=k))
    names = sorted({f"{word(3)} {word(2)} institute" for _ in range(2000)})
    df = spark.createDataFrame([("ORG", n) for n in names], "entity_type string, canon string")
    sc = spark.sparkContext

    def stages():
        none = sc._gateway.new_array(sc._jvm.double, 0)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        held = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (held.apply(i) for i in range(held.size()))}

    before = stages()
    linking.similar_names(df).collect()
    assert sum(n for k, n in stages().items() if k not in before) < 100 * len(names)


def test_min_label_groups_of_a_long_chain(spark):
    ids = [f"n{i:03d}" for i in range(200)]
    pairs = list(zip(ids, ids[1:])) + [("x", "y")]
    random.Random(1).shuffle(pairs)
    got = {r["id"]: r["group"] for r in linking.min_label_groups(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 202
    assert linking.min_label_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_vectors_repeat_and_are_of_unit_length():
    assert (linking.hashed_vector("abc") == linking.hashed_vector("abc")).all()
    assert abs((linking.hashed_vector("some name") ** 2).sum() - 1) < 1e-5


def test_model_stages(spark):
    df = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "query_id string, rank int, text string")

    def score(batches):
        for b in batches:
            yield b.assign(model_score=b["rank"].astype(float))

    assert [r["text"] for r in hooks.reranked(df, score, top=2).orderBy("place").collect()] == ["b", "a", "c"]
    assert [r["text"] for r in hooks.reranked(df).orderBy("place").collect()] == ["a", "b", "c"]
    assert hooks.resolved_references(df, "text").where("resolved = text").count() == 3

    def small(batches):
        for b in batches:
            if len(b) > 1:
                raise MemoryError
            yield b

    assert len(pd.concat(hooks.halving(small)(iter([pd.DataFrame({"x": range(5)})])))) == 5


def test_failed_rows_are_captured_and_queries_profiled(spark):
    def stage(batches):
        for b in batches:
            if (b["v"] == 3).any():
                raise ValueError("three")
            yield b.assign(twice=b["v"] * 2.0)

    df = spark.range(6).selectExpr("cast(id as int) as v").coalesce(1)
    full = lambda batches: (p.reindex(columns=["v", "twice", "error"]) for p in hooks.captured(stage)(batches))
    got = {r["v"]: (r["twice"], r["error"]) for r in df.mapInPandas(full, "v int, twice double, error string").collect()}
    assert got[3][1] == "ValueError: three" and got[2] == (4.0, None) and len(got) == 6
    seen = hooks.profiled(lambda: df.repartition(3).groupBy("v").count())
    assert seen["rows"] == 6 and seen["within_budget"] and seen["exchanges"] >= 1


def test_settings(tmp_path, monkeypatch):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"rag": {"rrf_k": 10, "odd": 1}}))
    monkeypatch.setenv("OLLAMA_HOST", "http://x")
    s, notes = settings.load_settings(str(p))
    assert s["rag"]["rrf_k"] == 10 and s["llm"]["base_url"] == "http://x" and "unknown key rag.odd" in notes and "missing key llm.timeout" in notes
    assert len(settings.flat(settings.DEFAULTS)) - len(settings.OPTIONAL) == 37
    base, notes = settings.load_settings(str(tmp_path / "none"))
    assert base["rag"]["rrf_k"] == 60 and notes[0].startswith("defaults")
    assert settings.differences(base, settings.cell(base, {"rag.rrf_k": 10})) == {"rag.rrf_k": (60, 10)}
    with pytest.raises(KeyError):
        settings.cell(base, {"rag.nope": 1})
    assert settings.parse_configs("3:1, 5:2") == [(3, 1), (5, 2)]
    for bad in ("2:2", "x"):
        with pytest.raises(ValueError):
            settings.parse_configs(bad)
    assert settings.expand_bitwidths("m:1b", ["q8_0", " ", "Q4_K_M"]) == [{"tag": "m:1b-q8_0", "bitwidth": "q8_0", "base": "m:1b"}, {"tag": "m:1b", "bitwidth": "Q4_K_M", "base": "m:1b"}]


def test_indented_settings(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("# head\nrag:\n  rrf_k: 30   # close\n  retrieval_mode: 'graph'\nentity_extraction:\n  gliner:\n    confidence_threshold: 0.4\n    entity_types:\n      - person\n      - city\nagent:\n  enable_verifier: false\n")
    s, notes = settings.load_settings(str(p))
    assert (s["rag"]["rrf_k"], s["rag"]["retrieval_mode"], s["entity_extraction"]["gliner"]["confidence_threshold"], s["agent"]["enable_verifier"]) == (30, "graph", 0.4, False)
    assert s["entity_extraction"]["gliner"]["entity_types"] == ["person", "city"] and "unknown key entity_extraction.gliner.entity_types" in notes
    (tmp_path / "bad.yaml").write_text("no colon here\n")
    assert settings.load_settings(str(tmp_path / "bad.yaml"))[1][0].startswith("defaults")


def test_relations_from_given_parses(spark):
    from lanefold.operators import parsing

    t = [
        # Ada Marsh directed Dawn and wrote Dusk
        ("d", 0, 0, 1, "Ada", "Ada", "PROPN", "compound"), ("d", 0, 1, 2, "Marsh", "Marsh", "PROPN", "nsubj"), ("d", 0, 2, 2, "directed", "direct", "VERB", "ROOT"), ("d", 0, 3, 2, "Dawn", "Dawn", "PROPN", "dobj"),
        ("d", 0, 4, 2, "and", "and", "CCONJ", "cc"), ("d", 0, 5, 2, "wrote", "write", "VERB", "conj"), ("d", 0, 6, 5, "Dusk", "Dusk", "PROPN", "dobj"),
        # Dawn was founded by Ada Marsh
        ("e", 0, 0, 2, "Dawn", "Dawn", "PROPN", "nsubjpass"), ("e", 0, 1, 2, "was", "be", "AUX", "auxpass"), ("e", 0, 2, 2, "founded", "found", "VERB", "ROOT"), ("e", 0, 3, 2, "by", "by", "ADP", "agent"),
        ("e", 0, 4, 5, "Ada", "Ada", "PROPN", "compound"), ("e", 0, 5, 3, "Marsh", "Marsh", "PROPN", "pobj"),
        # Ada Marsh worked in Dawn
        ("g", 0, 0, 1, "Ada", "Ada", "PROPN", "compound"), ("g", 0, 1, 2, "Marsh", "Marsh", "PROPN", "nsubj"), ("g", 0, 2, 2, "worked", "work", "VERB", "ROOT"), ("g", 0, 3, 2, "in", "in", "ADP", "prep"), ("g", 0, 4, 3, "Dawn", "Dawn", "PROPN", "pobj"),
        # the mother of Marsh
        ("f", 0, 0, 1, "the", "the", "DET", "det"), ("f", 0, 1, 1, "mother", "mother", "NOUN", "ROOT"), ("f", 0, 2, 1, "of", "of", "ADP", "prep"), ("f", 0, 3, 2, "Marsh", "Marsh", "PROPN", "pobj"),
    ]
    tokens = spark.createDataFrame(t, "doc string, sent int, i int, head int, text string, lemma string, pos string, dep string")
    names = spark.createDataFrame([("ada marsh", "A"), ("dawn pictures", "D"), ("dusk", "U"), ("x", "X")], "canon string, entity_id string")
    got = {tuple(r) for r in parsing.svo_relations(tokens, names).select("doc", "src", "relation_type", "dst").collect()}
    assert got == {("d", "A", "direct", "D"), ("d", "A", "write", "U"), ("e", "A", "found", "D"), ("g", "A", "work", "D")}
    assert [tuple(r) for r in parsing.passive_agents(tokens).collect()] == [("e", "Who found Dawn?")]
    named = spark.createDataFrame([("f", "Ada Marsh")], "doc string, name string")
    assert [tuple(r) for r in parsing.relational_nouns(tokens, named).collect()] == [("f", "Who is the mother of Ada Marsh?")]
    assert parsing.svo_relations(tokens.limit(0), names).count() == 0
    raw = spark.createDataFrame([("c", "Ada Marsh", "wrote", "Dusk", -0.1), ("c", "Adam", "wrote", "it", 0.2), ("c", "Ada", "wrote", "it", -5.0)], "chunk_id string, subject string, relation string, object string, score double")
    kept = parsing.sure_triples(raw, spark.createDataFrame([("c", "Ada")], "chunk_id string, name string")).collect()
    assert [(r["subject"], r["probability"]) for r in kept] == [("Ada Marsh", pytest.approx(0.904837))]
