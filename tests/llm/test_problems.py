"""Edge cases and brute-force checks of the training-data operators."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from compare import connect, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lanefold.llm import MODULES, cooccurrence, groups, leakage, names, packing, pairs, planted, ranking, spam, vectors

T = datetime(2025, 1, 1)


def test_statements_agree(spark, sf):
    con = connect(sf)
    for m in MODULES:
        for name, sql in m.ORACLE.items():
            assert rows(m.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(sql).df()), name


# --- co-occurrence ----------------------------------------------------------------------------------------------------

CHUNKS = "chunk_id string, entities array<struct<entity_id:string,name:string>>, relations array<struct<relation_type:string>>, together int"


def chunk(cid, ents, rels=()):
    return (cid, None if ents is None else [(e, "n") for e in ents], [(r,) for r in rels], 0)


def brute_pairs(baskets):
    out = {}
    for items in baskets.values():
        for a, b in itertools.combinations(sorted(items), 2):
            out[a, b] = out.get((a, b), 0) + 1
    return out


def test_gram_matches_brute_force_with_hot_items_large_baskets_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "ITEM_BLOCK", 8)
    rng = random.Random(1)
    baskets = {f"c{i}": set(rng.sample([f"e{j}" for j in range(60)], rng.randint(0, 6))) | ({"hot"} if i % 3 else set()) for i in range(300)}
    baskets["big"] = {f"e{j}" for j in range(50)}
    data = [chunk(c, [*s, None, *list(s)[:1]], ["r1", "r2"] if i % 2 else []) for i, (c, s) in enumerate(baskets.items())]
    data += [chunk("c0", list(baskets["c0"])), chunk(None, ["e1", "e2"]), chunk("none", None), chunk("blank", [])]
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence.cooccurrence(spark.createDataFrame(data, CHUNKS)).where("item_kind = 'entity'").collect()}
    want = brute_pairs(baskets)
    assert {k: r["together"] for k, r in got.items()} == want
    r = got["e1", "hot"]
    assert r["count_b"] == sum("hot" in s for s in baskets.values()) and r["n_chunks"] == len(baskets) + 2
    assert r["ratio"] == pytest.approx(r["together"] * r["n_chunks"] / (r["count_a"] * r["count_b"]))


def test_cooccurrence_of_nothing(spark):
    assert cooccurrence.cooccurrence(spark.createDataFrame([], CHUNKS), 5, 3.0).count() == 0


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=25), st.integers(0, 14))
def test_dense_and_sparse_parts_of_the_gram_agree(baskets, dense):
    r = np.concatenate([np.full(len(b), i) for i, b in enumerate(baskets)])
    c = np.concatenate([sorted(b) for b in baskets]).astype(np.int64)
    a, b, n = cooccurrence.gram(r, c, 13, dense)
    assert {(min(x, y), max(x, y)): z for x, y, z in zip(a, b, n)} == brute_pairs(dict(enumerate(baskets)))


# --- groups -----------------------------------------------------------------------------------------------------------

LINKS = "entity_id_a string, name_a string, entity_id_b string, name_b string, score double, id string"


def links(spark, pairs_):
    return spark.createDataFrame([(a, None, b, None, None, "x") for a, b in pairs_], LINKS)


def union_find(pairs_):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs_:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_groups_of_chains_hubs_cliques_and_odd_links(spark, monkeypatch):
    monkeypatch.setattr(groups, "PART_EDGES", 20)
    chain = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(120)]
    hub = [("hub", f"h{i}") for i in range(150)]
    p = chain + hub + [("k1", "k2"), ("k2", "k1"), ("k1", "k2"), ("k3", "k1"), ("s", "s"), (None, "n"), ("n", None), ("s2", "s2")]
    random.Random(3).shuffle(p)
    got = {r["entity_id"]: r["group_id"] for r in groups.entity_groups(links(spark, p)).collect()}
    assert got == union_find(p)


def test_groups_of_no_links(spark):
    assert groups.entity_groups(links(spark, [])).count() == 0
    assert groups.entity_groups(links(spark, [("s", "s"), (None, "a")])).count() == 0


# --- names ------------------------------------------------------------------------------------------------------------

ENTITIES = "entity_id string, name string, entity_type string, confidence double, group_id string"


def grouped(spark, named, kind="PERSON"):
    """Groups among ``named``, in a table of other names that share their common words."""
    rng = random.Random(9)
    other = ["".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(5)).title() for _ in range(300)]
    forms = ["Robert {}", "Rowan {}", "Margaret {}"] if kind == "PERSON" else ["{} Association for Marine Research", "{} Football Club", "{} Film Studios", "University of {}"]
    fill = [(f"f{k}", rng.choice(forms).format(x), kind, None, "") for k, x in enumerate(other)]
    df = spark.createDataFrame(fill + [(f"i{k}", n, kind, None, "x") for k, n in enumerate(named)] + [("i0", named[0], kind, 0.5, "y"), (None, "Ann Lee", kind, None, ""), ("z1", None, kind, None, ""), ("z2", "", kind, None, ""), ("z3", "?!", kind, None, ""), ("z4", named[0], "GPE", None, "")], ENTITIES)
    out = {}
    for r in names.variant_groups(df).collect():
        if r["entity_id"][0] == "i":
            out.setdefault(r["group_id"], set()).add(named[int(r["entity_id"][1:])])
    return sorted(map(sorted, out.values()))


def test_person_variants_are_linked_and_relatives_are_not(spark):
    named = ["Robert Quillfeather", "Bob Quillfeather", "Quillfeather, Robert", "Dr. R. Quillfeather", "Robert Quillfaether", "Röbert Quillfeather", "RobertQuillfeather", "Margaret Quillfeather", "M. Quillfeather", "Peggy Quillfeather", "Robert Sandhurst"]
    assert grouped(spark, named) == sorted([sorted(n for n in named if "M" not in n and "Peggy" not in n and "Sand" not in n), sorted(["Margaret Quillfeather", "M. Quillfeather", "Peggy Quillfeather"])])


def test_an_initial_that_fits_two_relatives_is_linked_to_neither(spark):
    named = ["Robert Quillfeather", "Rowan Quillfeather", "R. Quillfeather", "Robert Quillfaether"]
    assert grouped(spark, named) == [["Robert Quillfaether", "Robert Quillfeather"]]


def test_organisation_variants_are_linked_and_namesakes_are_not(spark):
    named = ["Quillfeather Association for Marine Research", "Quillfeather Assoc. for Marine Research", "Quillfeather AMR", "Marine Research, Quillfeather Association for", "Quillfeather Association for Marine Research e.V.", "Quillfeather Football Club", "Quillfeather F.C.", "Quillfeather Film Studios", "University of Sandhurst", "Sandhurst University", "Sandhurst Univ."]
    got = grouped(spark, named, "ORGANIZATION")
    assert got == sorted([sorted(named[:5]), sorted(named[5:7]), sorted(named[8:])])


def test_a_typo_meets_its_name_beside_a_more_frequent_near_name(spark):
    named = ["Robert Feldavlot", "Robert Feldavolt", "Rowan Feldvolt", "Margaret Feldvolt"]
    assert grouped(spark, named) == [["Robert Feldavlot", "Robert Feldavolt"]]


def test_similar_tokens_match_brute_force(spark):
    rng = random.Random(3)
    words = {"kim", "kym", "cruz", "curz", "cruuz", "smith", "smtih", "miller", "mliler", "hedda", "hdeda", "turner", "tumer", "vvilms", "wilms", "a" * 30, "a" * 32, "ab"}
    for n in range(3, 25):
        for _ in range(6):
            w = "".join(rng.choice("abcdefgrn") for _ in range(n))
            words.add(w)
            for _ in range(4):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcx") + w[at:], w[:at] + w[at : at + 2][::-1] + w[at + 2 :]])
                words.add(w)
    words = sorted(w for w in words if w)
    df = spark.createDataFrame([("PERSON", w) for w in words], "entity_type string, token string")
    got = [(r["a"], r["b"]) for r in names.similar_tokens(df).collect()]
    want = {(a, b) for a, b in itertools.permutations((w for w in words if len(w) > 2), 2) if names.close(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_candidates_cover_every_pair_that_compare_links(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK_ROWS", 7)
    rng = random.Random(12)
    first = ["Robert", "Bob", "R.", "Rob", "Roberta", "Rowan", "Margaret", "Peggy", "M."]
    last = ["Quillfeather", "Quillfaether", "Quilfeather", "Sandhurst", "Sandhursd"]
    people = sorted({f"{rng.choice(first)} {rng.choice(['', 'James ', 'J. '])}{rng.choice(last)}" for _ in range(150)})
    firms = ["Quillfeather Association for Marine Research", "Quillfeather AMR", "Quillfeather Assn Marine Research", "Quillfeather Dept. of Law", "Quillfeather Department of Law", "Quillfeather Football Club", "Quillfeather FC", "Sandhurst Steel Ltd", "Sandhurst Stl Limited"]
    listed = []
    for kind, group in (("PERSON", people), ("ORGANIZATION", firms)):
        sigs = sorted({" ".join(names.tokens(n, kind)) for n in group})
        voc = sorted({t for x in sigs for t in x.split()})
        near = {t: [u for u in voc if u != t and len(u) > 2 and len(t) > 2 and names.close(t, u)] for t in voc}
        weight = {t: 0.5 if len(t) == 1 else 3.0 if t[:2] in ("qu", "sa") else 2.0 for t in voc}
        listed += [(kind, x, x.split(), [weight[t] for t in x.split()], max(weight[t] for t in x.split()), {t: (weight[t], near[t]) for t in x.split()}) for x in sigs]
    df = spark.createDataFrame(listed, "entity_type string, sig string, t array<string>, weights array<double>, top double, w map<string, struct<weight:double,near:array<string>>>")
    got = {(r["entity_type"], r["a"], r["spelling_a"], r["b"], r["spelling_b"]) for r in names.candidate_pairs(df).collect()}
    keys = lambda r: [t for t in set(r[2]) if r[5][t][0] >= names.KEY_SHARE * r[4] and len(t) > 2]
    linked = 0
    for x, y in itertools.combinations(listed, 2):
        if x[0] != y[0]:
            continue
        for ka in keys(x):
            for kb in keys(y):
                if (ka == kb or kb in x[5][ka][1]) and names.compare(x[2], y[2], x[0], {t: v[0] for t, v in (x[5] | y[5]).items()}, (ka, kb))[0]:
                    linked += 1
                    assert (x[0], x[1], ka, y[1], kb) in got
    assert linked > 200 and len(got) < len(listed) ** 2


def test_a_name_of_many_is_linked_where_it_belongs(spark):
    rng = random.Random(5)
    firsts = sorted({"".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(900)})
    rows_ = [(f"n{i:04d}", f"{f} Quillfeather", "PERSON", None, "") for i, f in enumerate(firsts)] + [("x1", f"Quillfeather, {firsts[7]}", "PERSON", None, ""), ("x2", f"{firsts[7][0]}. Quillfeather", "PERSON", None, "")]
    got = {r["entity_id"]: r["group_id"] for r in names.variant_groups(spark.createDataFrame(rows_, ENTITIES)).collect()}
    assert got.get("x1") == "n0007" and "x2" not in got


def test_variants_of_nothing(spark):
    assert names.variant_groups(spark.createDataFrame([], ENTITIES)).count() == 0


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.text(alphabet="abcd", min_size=1, max_size=8), st.integers(0, 7), st.sampled_from("drsx"), st.sampled_from("abcd"))
def test_one_edit_is_near(word, at, op, letter):
    at = min(at, len(word) - 1)
    other = {"d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :], "s": word[:at] + word[at : at + 2][::-1] + word[at + 2 :], "x": word[:at] + letter + word[at:]}[op]
    assert names.near(word, other) and names.near(other, word)


def test_two_edits_are_close_only_in_long_words():
    assert not names.near("abcdefghij", "abdcefghijk") and names.close("abcdefghij", "abdcefghijk")
    assert not names.close("abcdef", "abdcefg") and names.near("turner", "tumer")
    assert not names.close("abcdefghij", "axcdefghxj") and not names.close("abcdefghij", "xbcdefghi")


# --- vectors ----------------------------------------------------------------------------------------------------------


def test_neighbours_recall_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((300, 64))
    x = np.repeat(centres, 8, axis=0) + 0.25 * rng.standard_normal((2400, 64))
    rows_ = [(f"v{i:04d}", [float(a) for a in v], None) for i, v in enumerate(x)]
    copy = [float(a) for a in x[0]]
    rows_ += [(f"w{i}", [2 * a for a in copy], None) for i in range(40)] + [("v0000", copy, T)]
    bad = [("n", None, None), ("e", [], None), ("s", [1.0] * 63, None), ("z", [0.0] * 64, None), ("nan", [float("nan")] + [1.0] * 63, None), ("inf", [float("inf")] + [1.0] * 63, None), (None, copy, None), ("null", [None] + [1.0] * 63, None)]
    df = spark.createDataFrame(rows_ + bad, "id string, v array<double>, other timestamp")
    got = {}
    for r in vectors.nearest(df, "id", "v").collect():
        got.setdefault(r["id"], []).append((r["other"], r["cosine"]))
    assert set(got) == {r[0] for r in rows_} and all(len(v) == 5 and k not in dict(v) for k, v in got.items())
    assert all(o[0] == "w" or o == "v0000" for o, _ in got["w39"]) and all(c == 1.0 for _, c in got["w39"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(1, 2400):
        s = u[1:] @ u[i]
        s[i - 1] = -2
        hits += len({f"v{j + 1:04d}" for j in np.argsort(-s)[:5]} & {o for o, _ in got[f"v{i:04d}"]})
    assert hits / (2399 * 5) > 0.9


def test_neighbours_of_few_or_none(spark):
    schema = "id string, v array<double>"
    assert vectors.nearest(spark.createDataFrame([], schema), "id", "v", dim=2).count() == 0
    assert vectors.nearest(spark.createDataFrame([("a", [1.0, 0.0])], schema), "id", "v", dim=2).count() == 0
    two = vectors.nearest(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], schema), "id", "v", dim=2).collect()
    assert {(r["id"], r["other"]) for r in two} == {("a", "b"), ("b", "a")}


def test_cells_beyond_the_depth_limit_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_DEPTH", 1)
    monkeypatch.setattr(vectors, "CELL", 50)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"v{i}", [float(a) for a in rng.standard_normal(8)]) for i in range(400)], "id string, v array<double>")
    assert vectors.nearest(df, "id", "v", dim=8).select("id").distinct().count() == 400


def test_neighbours_are_found_beyond_the_depth_limit(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_DEPTH", 2)
    monkeypatch.setattr(vectors, "CELL", 64)
    rng = np.random.default_rng(4)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 1500, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.87 * a + (1 - 0.87**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)  # 12 times the rows of four cells
    df = spark.createDataFrame([(f"{s}{i}", v.tolist()) for s, x in (("a", a), ("b", b)) for i, v in enumerate(x)], "id string, v array<double>")
    got = {(r["id"], r["other"]) for r in vectors.nearest(df, "id", "v").collect()}
    assert sum((f"a{i}", f"b{i}") in got for i in range(1500)) / 1500 > 0.95


# --- ranking ----------------------------------------------------------------------------------------------------------

RESULTS = "query_id string, chunk_id string, vector_score double, bm25_score double, graph_score double, rrf_score double, rank int"


def test_ranking_resists_ranges_outliers_nulls_and_ties(spark):
    q1 = [("q1", f"c{i:02d}", 0.5 + i / 100, 1000.0 * i, None if i % 2 else i / 10, i / 1000, 9) for i in range(12)]
    q2 = [("q2", c, v, 1.0, None, None, 9) for c, v in (("a", 0.5), ("b", 0.5), ("b", 0.5))]
    q3 = [("q3", "x", float("nan"), None, None, None, 9), (None, "x", 1.0, 1.0, 1.0, 1.0, 9), ("q4", None, 1.0, 1.0, 1.0, 1.0, 9)]
    df = spark.createDataFrame(q1 + q1[:3] + q2 + q3, RESULTS)
    out = {(r["query_id"], r["rank"]): r["chunk_id"] for r in ranking.ranking(df, chunk_rows=5).collect()}
    assert len(out) == 12 + 2 + 1 and out["q1", 1] == "c11" and out["q2", 1] == "a" and out["q3", 1] == "x"
    assert sorted(k[1] for k in out if k[0] == "q1") == list(range(1, 13))
    assert ranking.leaders(spark.createDataFrame([], RESULTS)).count() == 0 and ranking.ranking(spark.createDataFrame([], RESULTS)).count() == 0


def brute_closeness(x):
    """Closeness of the rows of a small score matrix (nan: not returned), by the definition."""
    ideal, anti = np.zeros(len(x)), np.zeros(len(x))
    for col in x.T:
        v = np.sort(col[~np.isnan(col)])
        if not len(v):
            continue
        q1, q3 = v[max(0, int(np.ceil(0.25 * len(v))) - 1)], v[max(0, int(np.ceil(0.75 * len(v))) - 1)]
        lo, hi = max(v[0], q1 - 3 * (q3 - q1)), min(v[-1], q3 + 3 * (q3 - q1))
        w = np.where(np.isnan(col), 0, np.clip(np.nan_to_num(col), lo, hi) - lo)
        w = w / (np.sqrt((w**2).sum()) or 1)
        ideal += 0.25 * (w.max() - w) ** 0.25
        anti += 0.25 * w**0.25
    ideal, anti = ideal**4, anti**4
    return np.where(ideal + anti > 0, anti / np.where(ideal + anti > 0, ideal + anti, 1), 0)


def test_closeness_matches_the_definition_also_in_a_hot_query(spark):
    rng = np.random.default_rng(4)
    data, want = [], {}
    for q, n in [("hot", 3000)] + [(f"q{i}", int(rng.integers(1, 30))) for i in range(60)]:
        x = np.column_stack([rng.random(n), rng.exponential(20, n), rng.random(n) * 0.3, rng.random(n) / 60])
        x[rng.random(x.shape) < 0.2] = np.nan
        x[0, 1] = 1e6
        for j, c in enumerate(brute_closeness(x)):
            want[q, f"c{j:05d}"] = c
        data += [(q, f"c{j:05d}", *[None if np.isnan(v) else float(v) for v in r], 0) for j, r in enumerate(x)]
    out = ranking.ranking(spark.createDataFrame(data, RESULTS), chunk_rows=500).collect()
    assert len(out) == len(want)
    assert max(abs(r["closeness"] - want[r["query_id"], r["chunk_id"]]) for r in out) < 1e-6
    hot = sorted((r for r in out if r["query_id"] == "hot"), key=lambda r: r["rank"])
    assert [r["rank"] for r in hot] == list(range(1, 3001)) and all(a["closeness"] >= b["closeness"] for a, b in zip(hot, hot[1:]))


def test_leaders_need_three_strict_firsts_and_a_fair_fourth(spark):
    base = [("q", f"c{i}", i / 10, i / 10, i / 10, (5 - i) / 10, 0) for i in range(6)]
    assert ranking.leaders(spark.createDataFrame(base, RESULTS)).count() == 0
    fair = [(*r[:5], 0.45 if r[1] == "c5" else r[5], 0) for r in base]
    assert [r["chunk_id"] for r in ranking.leaders(spark.createDataFrame(fair, RESULTS)).collect()] == ["c5"]


# --- packing ----------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None, derandomize=True)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_packing_keeps_all_limits(sizes):
    t = np.array(sizes)
    w = packing.pack(t, t // 2, (50, 4, 22 + 3))
    for x in set(w):
        at = w == x
        assert t[at].sum() <= 50 and at.sum() <= 4 and (t[at] // 2).sum() <= 25


def test_windows_split_only_long_texts_and_lose_nothing(spark):
    rng = random.Random(4)
    sizes = [(i, rng.randint(1, 900)) for i in range(3000)] + [(5000, 2048), (5001, 2049), (5002, 9000)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    out = packing.pack_windows(packing.pieces(df), group_items=500).toPandas()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == dict(sizes)
    assert set(out[out.piece > 0].doc_id) == {5001, 5002} and not out.duplicated(["doc_id", "piece"]).any()
    fill = out.groupby("window_id").n_tokens.sum()
    assert fill.max() <= 2048 and out.groupby("window_id").size().max() <= packing.MAX_SEGMENTS and fill.mean() > 0.98 * 2048
    assert packing.pack_windows(packing.pieces(df.limit(0))).count() == 0


@pytest.mark.parametrize("limits, binding", [((2048, 64, 4096), 1), ((2048, 512, 300), 2), ((700, 512, 4096), 0)])
def test_each_limit_binds_in_instruction_data(spark, limits, binding):
    rng = random.Random(8)
    rows_ = [(f"q{i}", rng.randint(8, 30), rng.randint(1, 8)) for i in range(4000)]
    df = spark.createDataFrame(rows_, "question_id string, n_tokens long, n_loss long")
    out = packing.pack_windows(df, limits, group_items=1000, keys=("question_id",)).toPandas()
    use = out.groupby("window_id").agg(t=("n_tokens", "sum"), s=("n_tokens", "size"), l=("n_loss", "sum")) / limits
    assert len(out) == 4000 and (use <= 1).all().all()
    assert use.sum().idxmax() == "tsl"[binding] and use["tsl"[binding]].mean() > 0.97
    least = max(-(-sum(r[1] for r in rows_) // limits[0]), -(-4000 // limits[1]), -(-sum(r[2] for r in rows_) // limits[2]))
    assert len(use) <= 1.03 * least + 1


def test_instruction_pairs_are_sized_by_their_answers(spark):
    rows_ = [("a", "two words", "one", 1), ("a", "two words", "one", 2), ("b", None, "one", 1), ("c", "", None, 1), (None, "x", "y", 1), ("d", "word " * 3000, "x", 1)]
    got = {r["question_id"]: (r["n_tokens"], r["n_loss"]) for r in packing.instruction_items(spark.createDataFrame(rows_, "question_id string, question string, gold_answer string, n_loss int")).collect()}
    assert got == {"a": (3, 1), "b": (1, 1)}
    with pytest.raises(ValueError):
        packing.pack(np.array([9]), np.array([1]), (8, 1, 8))


def test_pairs_beyond_a_window_are_cut_and_lose_nothing(spark, tmp_path):
    limits = (10, 96, 4)
    sizes = [(f"{p}-{a}", p, a) for p in range(24) for a in range(24) if p + a]
    df = spark.createDataFrame(sizes, "question_id string, n_prompt long, n_loss long")
    got = {k: list(g.itertuples()) for k, g in packing.pair_pieces(df, limits).toPandas().sort_values("piece").groupby("question_id")}
    for k, p, a in sizes:
        ends = list(itertools.accumulate(r.n_tokens for r in got[k]))
        assert [r.token_start for r in got[k]] == [0, *ends[:-1]] and ends[-1] == p + a and sum(r.n_loss for r in got[k]) == a, k
        assert [r.piece for r in got[k]] == list(range(len(ends))) and (len(ends) == 1) == (p + a <= 10 and a <= 4), k
        for r, end in zip(got[k], ends):
            assert 1 <= r.n_tokens <= 10 and r.n_loss <= 4 and r.n_loss == max(0, end - max(r.token_start, p)), k
    rows_ = [("a", "two words", "one"), ("b", "word " * 3000, "x"), ("c", "x", "word " * 600), ("d", "", None)]
    spark.createDataFrame(rows_, "question_id string, question string, gold_answer string").write.parquet(f"{tmp_path}/agentic_ablation.parquet")
    out = packing.p8_instructions(spark, str(tmp_path)).toPandas()
    assert set(out.question_id) == {"a", "b", "c"} and out[out.piece > 0].groupby("question_id").size().to_dict() == {"b": 1, "c": 1}
    use = out.groupby("window_id").agg(t=("n_tokens", "sum"), s=("n_tokens", "size"), l=("n_loss", "sum"))
    assert (use <= packing.PAIR_LIMITS).all().all() and use.t.sum() > 3600 and use.l.sum() > 600


def test_token_sizes_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (4, " "), (5, "é" * 20_000), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_sizes(df).collect()}
    assert got[1] == 2 and set(got) == {1, 4, 5}


# --- leakage ----------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, n=12):
    grams = lambda t: {tuple(w[i : i + n]) for w in [leakage.words(t or "")] for i in range(len(w) - n + 1)}
    held = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i, g in held.items() if g & grams(t)}


def test_leaks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    rng = random.Random(7)
    voc = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(5, 30)))) for i in range(15)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for d in range(80):
        body = rng.choices(voc + ["zz"], k=40)
        if d % 3 == 0:
            src = items[rng.randrange(15)][1].split()
            a = rng.randrange(len(src))
            body[10:10] = [w.upper() + rng.choice(["", ",", " -- "]) for w in src[a : a + rng.choice([11, 12, 20])]]
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "item_id"), spark.createDataFrame(items + items[:2], "item_id long, text string")
    out = leakage.leaks(ddf, idf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == brute_leaks(docs, items) and out
    r = out[0]
    item, doc = leakage.words(dict(items)[r["item_id"]]), leakage.words(dict(docs)[r["doc_id"]])
    hit = doc[r["first_word"] : r["first_word"] + r["n_words"]]
    assert any(item[i : i + len(hit)] == hit for i in range(len(item)))
    assert leakage.leaks(ddf.limit(0), idf).count() == 0 == leakage.leaks(ddf, idf.limit(0)).count()


def brute_longest(texts, items, n):
    out = {}
    for d, t in enumerate(texts):
        for i, text in items:
            w = leakage.words(text)
            best = (0, 0)
            for a in range(len(t)):
                for b in range(len(w)):
                    k = 0
                    while a + k < len(t) and b + k < len(w) and t[a + k] == w[b + k]:
                        k += 1
                    best = (k, a) if k > best[0] else best
            if best[0] >= n:
                out[d, i] = best
    return out


@pytest.mark.parametrize("seed", range(12))
def test_longest_matches_and_places_match_brute_force_in_repetitive_texts(seed):
    rng = random.Random(seed)
    voc, n = [f"w{i}" for i in range(rng.choice([2, 3, 8]))], rng.choice([3, 4, 12])
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(1, 25)))) for i in range(6)]
    texts = [items[0][1].split() * 3, []] + [rng.choices(voc + ["zz"], k=rng.randint(0, 40)) for _ in range(6)]
    got = {(d, i): (k, a) for d, i, k, a in zip(*[x.tolist() for x in leakage.EvalIndex(items, n).search(texts)])}
    assert got == brute_longest(texts, items, n)


def test_a_repeated_word_is_searched_not_paired_up():
    found = leakage.EvalIndex([(1, "a " * 4000)], 12).search([["a"] * 30_000])
    assert [x.tolist() for x in found] == [[0], [1], [4000], [0]]


def test_words_fold_case_accents_and_marks():
    assert leakage.words("Élan—STRASSE straße x_y 12½") == ["elan", "strasse", "strasse", "x", "y", "12"]


# --- stuffed pages ----------------------------------------------------------------------------------------------------


def test_stuffed_pages_are_told_from_prose_lists_and_refrains(spark):
    rng = random.Random(1)
    noun = ["river", "mayor", "school", "bridge", "engine", "garden", "letter", "winter", "market", "harbor", "painter", "railway"]
    name = ["Ada Marsh", "Otto Vane", "Lena Cole", "Ivo Hart"]
    say = lambda: f"The {rng.choice(noun)} of {rng.choice(name)} was built near the {rng.choice(noun)} in {rng.randint(1700, 2000)}, and it is still in use by the {rng.choice(noun)}."
    prose = [(i, " ".join(say() for _ in range(12))) for i in range(300)]
    cases = {
        1000: "Buy lamp now! Cheap lamp deals! Best lamp price! " * 15, 1001: "lamp sale cheap lamp price sale lamp cheap price lamp sale price " * 12, 1002: "\n".join(f"https://www.a{i}-shop.example/p/{i} lamp" for i in range(40)),
        1003: "Tags: " + ", ".join(f"{c} {n}" for c in ("red", "blue", "green", "oak") for n in noun), 1004: "\n".join(f"Desk Lamp X{100 + i} black {i}.99 sale" for i in range(30)),
    }
    fine = {2000: prose[0][1] + "\nReferences\n" + "\n".join(f"{i}. {rng.choice(name)} ({1900 + i}). The {rng.choice(noun).title()}. Oxford Press." for i in range(4)), 2001: "\n".join(say() + "\nO river of home, sing on, sing on." for _ in range(8)), 2002: prose[1][1] * 3, 2003: None, 2004: "", 2005: "   "}
    df = spark.createDataFrame(prose + list(cases.items()) + list(fine.items()), "doc_id long, text string")
    bad = {r["doc_id"] for r in spam.page_scores(df).where(f"share > {spam.SHARE}").collect()}
    assert bad == set(cases)
    assert spam.page_scores(df.limit(0)).count() == 0


def test_nothing_is_found_where_no_stretch_is_abnormal(spark, monkeypatch):
    pages = [(1, "lamp sale cheap lamp price sale lamp cheap price lamp sale price " * 12), (2, "https://a.example/x lamp " * 30), (3, "The mayor of the town was seen near the river, and it is still there. " * 20)]
    df = spark.createDataFrame(pages, "doc_id long, text string")
    assert {r["doc_id"] for r in spam.page_scores(df).where("share > 0.5").collect()} == {1, 2}
    monkeypatch.setattr(spam.ClassModel, "abnormal", lambda self, ratio: ratio < 0)
    model = spam.class_model(df)
    assert not spam.judge([t for _, t in pages], model)[0].any()


def test_texts_of_a_batch_do_not_touch():
    m = spam.ClassModel(np.array([5, 70, 4000]), np.array([3, 1, 9]))
    texts = ["", "one two", "   ", "lamp " * 40, "x", "The end of it.", "lamp " * 3]
    whole = spam.judge(texts, m)
    for i, t in enumerate(texts):
        assert np.allclose([x[i] for x in whole], [x[0] for x in spam.judge([t], m)])
    assert [(at, len(h)) for at, h in spam.slices(["ab", None, "c" * 9, "d"], 5)] == [(0, 3), (3, 1)] and list(spam.slices([])) == []


def test_class_model_is_a_distribution():
    m = spam.ClassModel(np.array([5, 70, 4000]), np.array([3, 1, 9]))
    assert np.allclose(np.exp(-m.nats.reshape(spam.N_SYMBOLS, spam.N_SYMBOLS, -1)).sum(2), 1)


# --- broken pairs -----------------------------------------------------------------------------------------------------


def test_defects_of_pairs(spark):
    rng = random.Random(2)
    town = ["Oslo", "Bergen", "Malmo", "Turku", "Odense", "Aarhus"]
    people = [a + " " + b for a in ("Ada", "Otto", "Lena", "Ivo") for b in ("Marsh", "Vane", "Colewood", "Hartford")]
    data = []
    for i in range(400):
        p, t = rng.choice(people), rng.choice(town)
        q = f"In which city was {p} born?"
        a = [t, f"{p} was born in the city of {t}.", f"The birthplace is {t}, a town in the north.", "I cannot determine the answer from the provided context.", q, f"{p} was born in the", "Die Antwort lautet " + t + ", so steht es im Text.", "n/a"][i % 8]
        data.append((f"q{i}", "r", q, t, a))
    q = "In which city was Ada Marsh born?"
    odd = {
        "e0": (None, "empty"), "e1": ("  ​", "empty"), "e2": ("[Error: timed out]", "empty"), "e3": ("<|im_end|>", "empty"), "e4": ("Answer:", "empty"), "c1": ("Question: in which city was ada marsh born", "question_copy"),
        "c2": (q + " " + q, "question_copy"), "f1": ("Она родилась в Осло.", "wrong_language"), "f2": ("La respuesta es Oslo, según el texto.", "wrong_language"), "t1": ("Ada Marsh was born in the city of Os", "truncated"), "t2": ("Ada Marsh was born in...", "truncated"),
        "r1": ("I don't know.", "refusal"), "ok1": ("Oslo", None), "ok2": ("I am not fully sure; most likely Oslo.", None), "ok3": (q + " Oslo", None), "ok4": ("Ada Marsh was born in the city of Turku", None), "ok5": ("Bergen; the other passages do not mention it.", None),
    }
    data += [(k, "r", q, "Oslo", a) for k, (a, _) in odd.items()] + [("n", None, None, None, "Oslo"), ("ok1", "r", q, "Oslo", "Oslo")]
    got = {r["question_id"]: r["defect_type"] for r in pairs.broken_pairs(spark.createDataFrame([(*d, "x") for d in data], "question_id string, row_name string, question string, gold_answer string, predicted_answer string, template string").drop("template")).collect()}
    assert {k: got.get(k) for k in odd} == {k: d for k, (_, d) in odd.items()}
    want = [None, None, None, "refusal", "question_copy", "truncated", "wrong_language", "empty"]
    assert [got.get(f"q{i}") for i in range(400)] == [want[i % 8] for i in range(400)]


def test_defects_of_nothing(spark):
    assert pairs.broken_pairs(spark.createDataFrame([], "question_id string, row_name string, question string, gold_answer string, predicted_answer string")).count() == 0


def test_crf_learns_a_sequence_rule():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(300):
        n = rng.integers(1, 5)
        x = np.zeros((n, len(pairs.FEATURES)))
        x[:, 0] = 1
        x[-1, pairs.NUMBER["last"]] = 1
        x[:, pairs.NUMBER["foreign_words"]] = rng.integers(0, 2, n)
        y = np.where(x[:, pairs.NUMBER["foreign_words"]] > 0, pairs.FOREIGN, pairs.ANSWER)
        xs.append(x), ys.append(y)
    crf = pairs.ClauseCRF().fit(xs, ys)
    assert all(np.array_equal(crf.tag(x), y) for x, y in zip(xs, ys))


@pytest.mark.parametrize("tag, name", [(pairs.ANSWER, None), (pairs.REFUSAL, "refusal"), (pairs.ECHO, "question_copy"), (pairs.FOREIGN, "wrong_language"), (pairs.UNFINISHED, "truncated")])
def test_defects_follow_the_tags_alone(tag, name):
    crf = pairs.ClauseCRF()
    crf.w[pairs.NUMBER["bias"], tag] = 9
    for answer in ("Oslo is the city.", "I cannot say.", "Where was Ada born?", "Sie wurde in Oslo geboren, so", "no"):
        assert pairs.defect("Where was Ada born?", "Oslo", answer, 3, 0, crf) == name
    assert pairs.defect("Where was Ada born?", "Oslo", "n/a", 0, 0, crf) == "empty"


def test_planted_defects_are_what_they_are_called():
    rng = random.Random(1)
    rows_ = [(f"In which city was P{i} born?", "Oslo", "P was born in the city of Oslo.", "Q was born in the city of N", "en", False, True) for i in range(9)]
    rows_ += [(f"In welcher Stadt wurde P{i} geboren?", "Rom", "P wurde in der Stadt Rom geboren.", "Q wurde in der Stadt N geboren", "de", False, True) for i in range(9)]
    rows_ += [(f"In which city was P{i} born?", f"T{i}", "I cannot say.", "i cannot say", "en", True, True) for i in range(9)]
    donors = planted.Donors(rows_)
    assert donors.endings("Q was born in the city of") == (0, 9) and donors.endings("i cannot say") == (9, 0)
    assert donors.declining == {"i cannot say"} and set(donors.sound) == {"en", "de"}
    made = [x for r in rows_ * 30 for x in planted.sequences(r, donors, rng)]
    for kind, text, _ in made:
        if kind == "unfinished":
            assert not text.endswith("Oslo.") and text != "P was born in the city of Oslo"
        if kind == "refusal":
            assert text.startswith("I cannot say")
    assert {k for k, _, _ in made} >= {"answer", "unfinished", "echo", "echo+answer", "foreign", "refusal"}
    assert planted.other_option("Which came first, The Dawn or The Dusk?", "The Dusk") == "The Dawn" and planted.other_option("Who?", "x") is None


def test_long_responses_and_empty_samples_train(spark):
    long_ = "Ada Marsh was born in Oslo. " * 3000
    df = spark.createDataFrame([("q", "r", "Where was Ada Marsh born?", "Oslo", long_), ("e", "r", None, None, None)], "question_id string, row_name string, question string, gold_answer string, predicted_answer string")
    assert {(r["question_id"], r["defect_type"]) for r in pairs.broken_pairs(df).collect()} == {("e", "empty")}
