"""Filters over ranked lists. Input: the fused list of each query, at most TOP_K rows, so a query's fold is bounded.

Every filter takes rows (query_id, rank, chunk_id, text, score, ...) and returns a part of them, so they chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.functions.text import blank_tokens, jaccard
from lanefold.operators.graph import _QE, e27_question_entities
from lanefold.operators.retrieval import _ALL, f02_subquery_fusion, r08_rrf_fusion
from lanefold.plans.planner import _CLS, _HOPS, plans
from lanefold.sources.shared import load, materialise

#: Share of the best score, token overlap, chunks after filtering, chunks and characters of a prompt, and of a chunk.
RELEVANCE, REDUNDANCY, BUDGET, MAX_DOCS, CHAR_BUDGET, SHRINK = 0.6, 0.8, 8, 5, 3500, 800
#: Fixed values of contradictions: least overlap, ratio of values, least value, letters around a number, years.
OVERLAP, RATIO, LEAST, AROUND, YEARS = 0.3, 2.0, 100, 25, (1000, 2100)
IMMUNE, SURVIVORS, CONFIDENT_GAP = 2, 5, 1.5
#: Words that mark a number as a count or as a year; words without weight in questions.
COUNT_WORDS = (
    "population people inhabitants residents members employees employs employ staff workers users subscribers votes voters seats kilometers km "
    "miles dollars euros pounds versus vs"
).split()
YEAR_WORDS = "year born founded established released published elected incorporated".split() + ["ad ", "bc ", "ce "]
QUERY_STOPS = (
    "a an and are as at be been by do did does for from had has have he her his in into is it its of on or she that the their this to was were "
    "what when where which who whom whose will with would they them you your we our i than more most less fewer first used during"
).split()
NUMBER = r"\b\d+(?:\.\d+)?\b"
SENTENCE = r"(?<=[.!?])\s+"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, chunk_id, text, rrf, score, method, source_doc: the fused twenty best of each query with their texts."""
    text = load(spark, sf_dir, "chunk_extractions").groupBy("chunk_id").agg(F.max("text").alias("text"))
    rows = r08_rrf_fusion(spark, sf_dir).join(text, "chunk_id", "left")
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("score", F.col("rrf"))


def relevant(rows: DataFrame, parallel: DataFrame | None = None) -> DataFrame:
    """rows of at least RELEVANCE of their query's best score; lists of several parallel sub-queries (``parallel``:
    query_id, n_parallel) pass whole."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    r = rows.where(F.col("score").isNotNull()).withColumn("_best", best)
    if parallel is None:
        return r.where(F.col("score") >= RELEVANCE * F.col("_best")).drop("_best")
    r = r.join(parallel, "query_id", "left")
    return r.where((F.col("n_parallel") > 1) | (F.col("score") >= RELEVANCE * F.col("_best"))).drop("_best", "n_parallel")


def sets_of(rows: DataFrame) -> DataFrame:
    """(query_id, rank, t, n): the distinct lower-cased tokens of each text."""
    return rows.select("query_id", "rank", F.array_distinct(blank_tokens(F.col("text"))).alias("t")).withColumn("n", F.size("t"))


def list_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of one list's rows, a the better ranked; a list has at most TOP_K rows."""
    a, b = (rows.select("query_id", *[F.col(c).alias(f"{c}_{s}") for c in ["rank", *columns]]) for s in "ab")
    return a.join(b, "query_id").where("rank_a < rank_b")


def overlap_of(p: DataFrame) -> DataFrame:
    """Pairs with ``overlap``, the Jaccard of their token sets; pairs whose sizes rule OVERLAP out are dropped first."""
    p = p.where((F.least("n_a", "n_b") > 0) & (F.least("n_a", "n_b") > OVERLAP * F.greatest("n_a", "n_b")))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return p.withColumn("_s", shared).withColumn("overlap", F.col("_s") / (F.col("n_a") + F.col("n_b") - F.col("_s"))).drop("_s")


def without_redundant(rows: DataFrame) -> DataFrame:
    """in rank order, a row whose overlap with any kept one is above REDUNDANCY goes."""
    near = overlap_of(list_pairs(sets_of(rows), ["t", "n"])).where(F.col("overlap") > REDUNDANCY)
    near = near.groupBy("query_id", "rank_b").agg(F.collect_list("rank_a").alias("better"))
    near = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank_b", "better"))).alias("l"))
    gone = F.aggregate("l", F.array().cast("array<int>"), lambda acc, x: F.when(F.size(F.array_except(x["better"], acc)) > 0, F.concat(acc, F.array(x["rank_b"]))).otherwise(acc))
    gone = near.select("query_id", F.explode(gone).alias("rank"))
    return rows.join(gone, ["query_id", "rank"], "left_anti")


def numbers_of(text: Column) -> Column:
    """the numbers of a text above LEAST as (value, whether it reads as a year), by the words around each."""
    between, found = F.split(text, NUMBER, -1), F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    total = lambda a, n: F.aggregate(F.transform(F.slice(a, 1, n), F.length), F.lit(0), lambda x, y: x + y)

    def one(i: Column) -> Column:
        start = total(between, i) + total(found, i - 1)
        value = F.element_at(found, i)
        lo = F.greatest(F.lit(0), start - AROUND)
        near = F.substring(F.lower(text), lo + 1, start + F.length(value) + AROUND - lo)
        said = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: near.contains(w))
        v = value.cast("double")
        year = said(YEAR_WORDS) | (~said(COUNT_WORDS) & v.between(*YEARS) & (v == F.floor(v)))
        return F.struct(v.alias("v"), year.alias("year"))

    every = F.transform(F.sequence(F.lit(1), F.size(found)), one)
    return F.when(F.size(found) > 0, F.filter(every, lambda x: x["v"] > LEAST)).otherwise(F.array().cast("array<struct<v:double,year:boolean>>"))


def without_contradicting(rows: DataFrame) -> DataFrame:
    """of two similar texts with numbers of one kind that differ beyond RATIO the lower scored goes; a list that would
    lose all rows keeps all."""
    held = rows.select("query_id", "rank", "score", numbers_of(F.col("text")).alias("v")).join(sets_of(rows), ["query_id", "rank"])
    p = overlap_of(list_pairs(held.where(F.size("v") > 0), ["t", "n", "v", "score"])).where(F.col("overlap") > OVERLAP)
    apart = lambda a, b: (F.greatest(a["v"], b["v"]) / F.least(a["v"], b["v"]) > RATIO) & (a["year"] == b["year"])
    p = p.where(F.exists("v_a", lambda a: F.exists("v_b", lambda b: apart(a, b))))
    gone = p.select("query_id", F.when(F.col("score_a") < F.col("score_b"), F.col("rank_a")).otherwise(F.col("rank_b")).alias("rank")).distinct()
    marked = rows.join(gone.withColumn("_gone", F.lit(1)), ["query_id", "rank"], "left")
    alive = F.count(F.when(F.col("_gone").isNull(), 1)).over(Window.partitionBy("query_id"))
    return marked.withColumn("_alive", alive).where(F.col("_gone").isNull() | (F.col("_alive") == 0)).drop("_gone", "_alive")


def without_covered(rows: DataFrame, named: DataFrame) -> DataFrame:
    """a row goes if its chunk's entities (``named``: chunk_id, e) all stand in a better ranked one; chunks without stay."""
    r = rows.select("query_id", "rank", "chunk_id").join(named, "chunk_id").where(F.size("e") > 0).select("query_id", "rank", "e")
    gone = list_pairs(r, ["e"]).where(F.size(F.array_except("e_b", "e_a")) == 0).select("query_id", F.col("rank_b").alias("rank")).distinct()
    return rows.join(gone, ["query_id", "rank"], "left_anti")


def plain_words(c: Column) -> Column:
    """Lower-cased words between single blanks, with one in front and behind, so that a phrase can be looked up whole."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def tiers(text: Column, names: Column, content: Column) -> Column:
    """0 a specific entity, 1 a generic one or strong overlap with the question's words, 2 neither; 0 without entities.

    An entity of several words is found as a whole, by one word of eight letters or more, or by all of its words of three
    or more; a single word of five letters or more as a word. Several words, or eight letters, make an entity specific.
    """
    low, padded = F.lower(text), plain_words(text)
    word = lambda w: padded.contains(plain_words(w))
    split = lambda n: F.filter(F.split(n, r"\s+"), lambda x: x != "")
    rest = lambda n: F.filter(split(n), lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(QUERY_STOPS))
    many = lambda n: F.size(split(n)) > 1
    whole = lambda n: low.contains(F.lower(n)) | F.exists(split(n), lambda x: (F.length(x) >= 8) & word(x)) | ((F.size(rest(n)) > 0) & F.forall(rest(n), word))
    hit = lambda n: F.when(many(n), whole(n)).otherwise(F.exists(split(n), lambda x: (F.length(x) >= 5) & word(x)))
    specific = F.exists(names, lambda n: hit(n) & (many(n) | (F.length(n) >= 8)))
    shared = F.size(F.filter(content, word))
    strong = (F.size(content) > 0) & (shared >= 2) & (shared / F.size(content) >= 0.5)
    return F.when((F.size(names) == 0) | specific, 0).when(F.exists(names, hit) | strong, 1).otherwise(2)


def question_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(QUERY_STOPS)))


def tiered(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows with tier and place; the IMMUNE best ranked stay, and at least SURVIVORS rows, by tier and rank.

    ``asked``: query_id, question, entities.
    """
    r = rows.join(asked, "query_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    own = F.flatten(F.transform("entities", lambda n: F.regexp_extract_all(F.lower(n), F.lit("([a-z0-9]+)"), F.lit(1))))
    content = F.array_except(F.filter(question_words(F.col("question")), lambda w: F.length(w) >= 4), own)
    r = r.withColumn("tier", tiers(F.col("text"), F.col("entities"), content)).drop("question", "entities")
    keep = (F.col("tier") < 2) | (F.col("rank") <= IMMUNE)
    w = Window.partitionBy("query_id")
    r = r.withColumn("_keep", keep).withColumn("_n", F.count(F.when(F.col("_keep"), 1)).over(w)).withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "_keep").orderBy("rank")))
    r = r.where(F.col("_keep") | (F.col("_i") <= SURVIVORS - F.col("_n"))).drop("_keep", "_n", "_i")
    return r.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank")))


def fair_cap(rows: DataFrame, group: str, budget: int = BUDGET) -> DataFrame:
    """``budget`` rows per query, dealt round-robin over the groups, the group of the best row first; adds place."""
    g = Window.partitionBy("query_id", group)
    r = rows.withColumn("_turn", F.row_number().over(g.orderBy("rank"))).withColumn("_lead", F.min("rank").over(g))
    w = Window.partitionBy("query_id").orderBy("_turn", "_lead", "rank")
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget).drop("_turn", "_lead")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE), lambda p: p != "")


def shrunk(text: Column, names: Column, budget: int = SHRINK) -> Column:
    """over budget, sentences that name an entity come first, then the others, up to the first that does not fit."""
    named = lambda p: F.exists(names, lambda n: F.lower(p).contains(F.lower(n)))
    order = F.concat(F.filter(sentences(text), named), F.filter(sentences(text), lambda p: ~named(p)))
    used = lambda i: F.aggregate(F.slice(order, 1, i), F.lit(0), lambda a, p: a + F.length(p) + 1)
    over = F.transform(order, lambda p, i: (i > 0) & (used(i) + F.length(p) > budget))
    n = F.array_position(over, True)
    return F.when(F.length(text) <= budget, text).otherwise(F.array_join(F.when(n > 0, F.slice(order, 1, F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(order), " "))


def truncated(text: Column, words: Column, budget: int = SHRINK) -> Column:
    """sentences with most of the question's words first, each taken that fits, put back in their order; without any,
    the first ``budget`` letters."""
    share = lambda p: F.size(F.array_intersect(words, F.regexp_extract_all(F.lower(p), F.lit("([a-z0-9]+)"), F.lit(1))))
    order = F.array_sort(F.transform(sentences(text), lambda p, i: F.struct((-share(p)).alias("s"), i.alias("i"), p.alias("p"))))
    none = F.struct(F.slice(order, 1, 0).alias("kept"), F.lit(0).alias("used"))
    fits = lambda acc, x: acc["used"] + F.length(x["p"]) + 1 <= budget
    kept = F.aggregate(order, none, lambda acc, x: F.when(fits(acc, x), F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), (acc["used"] + F.length(x["p"]) + 1).alias("used"))).otherwise(acc))["kept"]
    back = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"]), " ")
    return F.when(F.length(text) <= budget, text).when(back != "", back).otherwise(F.substring(text, 1, budget))


def reordered(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows with place by the question's words found as substrings, weighted by rarity in lists of four or more, over the
    root of the number of tokens."""
    r = rows.join(asked.select("query_id", F.explode(question_words(F.col("question"))).alias("w")), "query_id").where(F.lower("text").contains(F.col("w")))
    df = r.groupBy("query_id", "w").agg(F.count(F.lit(1)).alias("df"))
    n = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    idf = F.when(F.col("n") >= 4, F.log((F.col("n") + 1) / (F.col("df") + 0.5))).otherwise(F.lit(1.0))
    s = r.select("query_id", "rank", "w").join(df, ["query_id", "w"]).join(n, "query_id").groupBy("query_id", "rank").agg(F.sum(idf).alias("_s"))
    root = F.sqrt(F.greatest(F.lit(1), F.size(blank_tokens(F.col("text")))))
    out = rows.join(s, ["query_id", "rank"], "left").withColumn("_s", F.round(F.coalesce("_s", F.lit(0.0)) / root, 9))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "rank"))).drop("_s")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question, entities) of every question."""
    e = e27_question_entities(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("entities"))
    q = load(spark, sf_dir, "agentic_ablation").where(F.col("question_id").isNotNull()).groupBy(F.col("question_id").alias("query_id")).agg(F.max("question").alias("question"))
    return q.join(e, "query_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, e): the lower-cased entity names of each chunk."""
    return load(spark, sf_dir, "chunk_extractions").select("chunk_id", F.explode("entities").alias("e")).groupBy("chunk_id").agg(F.collect_set(F.lower("e.name")).alias("e"))


def parallel_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, n_parallel): hops of each plan that depend on no other."""
    return plans(spark, sf_dir).select("query_id", F.size(F.filter("hops", lambda h: F.size(h["depends_on"]) == 0)).alias("n_parallel"))


def f03_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r08_rrf_fusion(spark, sf_dir).withColumn("score", F.col("rrf"))
    return relevant(rows, parallel_hops(spark, sf_dir)).select("query_id", "chunk_id", "rank")


def f05_jaccard_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token overlap of every chunk with its query's first."""
    r = ranked(spark, sf_dir).select("query_id", "rank", "chunk_id", blank_tokens(F.col("text")).alias("t"))
    first = r.where("rank = 1").select("query_id", F.col("t").alias("f"))
    return r.join(first, "query_id").select("query_id", "chunk_id", F.round(jaccard(F.col("t"), F.col("f")), 6).alias("overlap"))


def f04_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_redundant(ranked(spark, sf_dir)).select("query_id", "chunk_id", "rank")


def f06_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_contradicting(ranked(spark, sf_dir)).select("query_id", "chunk_id", "rank")


def f07_entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_covered(r08_rrf_fusion(spark, sf_dir), chunk_names(spark, sf_dir)).select("query_id", "chunk_id", "rank")


def f08_entity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(ranked(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "chunk_id", "tier", "place")


def by_sub_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best rows of each query after sub-query fusion (F02), with their best sub-query and text."""
    text = load(spark, sf_dir, "chunk_extractions").groupBy("chunk_id").agg(F.max("text").alias("text"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")
    r = f02_subquery_fusion(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 20").join(text, "chunk_id", "left")
    return r.select("query_id", "rank", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.col("rrf").alias("score"), "best_sub_query")


def f09_fair_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_cap(by_sub_query(spark, sf_dir), "best_sub_query").select("query_id", "chunk_id", "best_sub_query", "place")


def f01_navigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a question's lists from end to end: sub-query fusion, relevance, redundancy, contradictions, entity overlap,
    tiers, fair cap over sub-queries, and shrinkage of the chunks that stay."""
    q = materialise(asked(spark, sf_dir), "asked")
    rows = materialise(relevant(by_sub_query(spark, sf_dir), parallel_hops(spark, sf_dir)), "relevant")
    rows = materialise(without_redundant(rows), "not-redundant")  # every filter reads its rows more than once
    rows = materialise(without_contradicting(rows), "not-contradicting")
    rows = materialise(without_covered(rows, chunk_names(spark, sf_dir)), "not-covered")
    kept = tiered(rows, q).drop("rank").withColumnRenamed("place", "rank")
    out = fair_cap(kept, "best_sub_query").join(q.select("query_id", "entities"), "query_id", "left")
    return out.select("query_id", "place", "chunk_id", "best_sub_query", "tier", shrunk(F.col("text"), F.coalesce("entities", F.array().cast("array<string>"))).alias("text"))


def f12_hop_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUDGET rows per query: an equal quota for each hop distance, the rest by rank."""
    r = r08_rrf_fusion(spark, sf_dir)
    hops = r.groupBy("query_id").agg(F.countDistinct("hop_distance").alias("n_hops"))
    r = r.join(hops, "query_id").withColumn("i", F.row_number().over(Window.partitionBy("query_id", "hop_distance").orderBy("rank")))
    first = F.col("i") <= F.floor(F.lit(BUDGET) / F.col("n_hops"))
    r = r.withColumn("j", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(first, 0).otherwise(1), "rank"))).where(F.col("j") <= BUDGET)
    return r.select("query_id", "chunk_id", "hop_distance", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place"))


def f11_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each query's chunks in question order, shrunk around its entities and cut sentence-aware."""
    q = asked(spark, sf_dir)
    r = reordered(ranked(spark, sf_dir), q).join(q, "query_id", "left")
    names = F.coalesce("entities", F.array().cast("array<string>"))
    return r.select("query_id", "chunk_id", "place", shrunk(F.col("text"), names).alias("shrunk"), truncated(F.col("text"), question_words(F.col("question"))).alias("cut"))


def f15_prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first MAX_DOCS chunks as numbered lines, up to CHAR_BUDGET characters."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = ranked(spark, sf_dir).where(F.col("rank") <= MAX_DOCS).withColumn("line", line).withColumn("upto", F.sum(F.length("line")).over(w)).where(F.col("upto") <= CHAR_BUDGET)
    return r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"), F.count(F.lit(1)).alias("n_chunks"))


def f16_retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: high if two of three signals fire, medium if one: the first score is 1.5 times the second or more, the first
    chunk stands in two lanes, all question entities stand in the three first texts. A list of one is low."""
    e = e27_question_entities(spark, sf_dir).groupBy("query_id").agg(F.collect_set(F.lower("key")).alias("e"))
    r = ranked(spark, sf_dir).where(F.col("rank") <= 3)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, c))
    g = r.groupBy("query_id").agg(
        at(1, F.col("rrf")).alias("a"), at(2, F.col("rrf")).alias("b"), at(1, (F.col("method") == "hybrid").cast("int")).alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.lower("text").alias("t")))), lambda x: x["t"]), " ").alias("t"),
    ).join(e, "query_id", "left")
    named = F.coalesce(F.forall("e", lambda x: F.col("t").contains(x)), F.lit(False))
    n = (F.col("a") / F.greatest("b", F.lit(1e-6)) >= 1.5).cast("int") + F.col("h") + named.cast("int")
    return g.select("query_id", F.when(F.col("b").isNull(), "low").when(n >= 2, "high").when(n == 1, "medium").otherwise("low").alias("level"))


QUERIES = {f.__name__: f for f in (f01_navigate, f03_relevance, f04_redundancy, f05_jaccard_to_first, f06_contradiction, f07_entity_overlap, f08_entity_tiers, f09_fair_cap, f11_context, f12_hop_merge, f15_prompt_context, f16_retrieval_confidence)}

_T = _ALL + ", k AS (SELECT query_id, chunk_id, rrf, method, rank, hop_distance FROM t WHERE rank <= 20), x AS (SELECT chunk_id, max(text) AS text FROM chunk_extractions GROUP BY 1), kt AS (SELECT k.*, coalesce(text, '') AS text, rrf AS score FROM k LEFT JOIN x USING (chunk_id))"
_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))"
_PH = _HOPS + ", ph AS (SELECT query_id, len(list_filter(hops, lambda h: len(h.depends_on) = 0)) AS n_parallel FROM pe)"
_CN = ", cn AS (SELECT chunk_id, list(DISTINCT lower(e.name)) FILTER (e.name IS NOT NULL) AS e FROM (SELECT chunk_id, unnest(entities) AS e FROM chunk_extractions) GROUP BY 1)"
_SUB = """, su AS (SELECT query_id, chunk_id, source_doc, 'vector' AS sq, vector_score AS s FROM r UNION ALL SELECT query_id, chunk_id, source_doc, 'graph', graph_score FROM r UNION ALL SELECT query_id, chunk_id, source_doc, 'bm25', bm25_score FROM r),
    sp AS (SELECT *, row_number() OVER (PARTITION BY query_id, sq ORDER BY s DESC, chunk_id) - 1 AS place FROM su WHERE s IS NOT NULL AND NOT isnan(s)),
    sg AS (SELECT query_id, chunk_id, sum(1 / (60 + place)) AS s, greatest(count(DISTINCT source_doc), 1) AS sources, count(DISTINCT sq) AS subs, (list(sq ORDER BY place, sq))[1] AS best_sub_query FROM sp GROUP BY 1, 2),
    sb AS (SELECT query_id, chunk_id, round(s * (1 + 0.1::DOUBLE * (sources - 1) + 0.05::DOUBLE * (subs - 1)), 9) AS score, best_sub_query FROM sg),
    bs AS (SELECT sb.*, coalesce(text, '') AS text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sb.chunk_id) AS rank FROM sb LEFT JOIN x USING (chunk_id) QUALIFY rank <= 20)"""


def _qs(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ASK = ", " + _QE + f""", ae AS (SELECT query_id, list_sort(list(DISTINCT key)) AS entities FROM qk GROUP BY 1), aq AS (SELECT question_id AS query_id, max(question) AS question FROM agentic_ablation WHERE question_id IS NOT NULL GROUP BY 1),
    ak AS (SELECT query_id, question, coalesce(entities, []::VARCHAR[]) AS entities, list_distinct(list_filter(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+'), lambda w: w NOT IN ({_qs(QUERY_STOPS)}))) AS words FROM aq LEFT JOIN ae USING (query_id))"""


def _relevant(x: str, y: str) -> str:
    return f", {y}_b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM {x}), {y} AS (SELECT * EXCLUDE (best) FROM {y}_b WHERE query_id IN (SELECT query_id FROM ph WHERE n_parallel > 1) OR score >= 0.6 * best)"


def _sets(x: str, y: str) -> str:
    return f", {y}_t AS (SELECT query_id, rank, score, text, {_TOK} AS t FROM {x}), {y}_p AS (SELECT a.query_id, a.rank AS ra, b.rank AS rb, a.score AS sa, b.score AS sb, a.text AS xa, b.text AS xb, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS o FROM {y}_t a JOIN {y}_t b ON a.query_id = b.query_id AND a.rank < b.rank WHERE len(a.t) > 0 AND len(b.t) > 0)"


def _redundant(x: str, y: str) -> str:
    return _sets(x, y) + f""", {y}_n AS (SELECT query_id, rb, list(ra) AS n FROM {y}_p WHERE o > 0.8 GROUP BY 1, 2), {y}_l AS (SELECT query_id, list({{'r': rb, 'n': n}} ORDER BY rb) AS l FROM {y}_n GROUP BY 1),
        {y}_d AS (SELECT query_id, list_reduce(l, lambda a, x: CASE WHEN len(list_filter(x.n, lambda z: NOT list_contains(a, z))) > 0 THEN list_append(a, x.r) ELSE a END, []::BIGINT[]) AS gone FROM {y}_l),
        {y} AS (SELECT {x}.* FROM {x} LEFT JOIN {y}_d USING (query_id) WHERE NOT coalesce(list_contains(gone, rank), FALSE))"""


def _numbers(t: str) -> str:
    between, found = f"regexp_split_to_array({t}, '{NUMBER}')", f"regexp_extract_all({t}, '{NUMBER}')"
    total = lambda a, n: f"coalesce(list_sum(list_transform({a}[1:{n}], lambda z: length(z))), 0)"
    start = f"({total(between, 'i')} + {total(found, 'i - 1')})"
    near = f"substring(lower({t}), (greatest(0, {start} - {AROUND}) + 1)::INT, ({start} + length({found}[i]) + {AROUND} - greatest(0, {start} - {AROUND}))::INT)"
    said = lambda words: "(" + " OR ".join(f"contains({near}, '{w}')" for w in words) + ")"
    v = f"{found}[i]::DOUBLE"
    return f"list_filter(list_transform(range(1, len({found}) + 1), lambda i: {{'v': {v}, 'year': {said(YEAR_WORDS)} OR (NOT {said(COUNT_WORDS)} AND {v} BETWEEN {YEARS[0]} AND {YEARS[1]} AND {v} = floor({v}))}}), lambda n: n.v > {LEAST})"


def _contradicting(x: str, y: str) -> str:
    return _sets(x, y) + f""", {y}_v AS (SELECT query_id, ra, rb, sa, sb, {_numbers('xa')} AS va, {_numbers('xb')} AS vb FROM {y}_p WHERE o > 0.3),
        {y}_d AS (SELECT DISTINCT query_id, CASE WHEN sa < sb THEN ra ELSE rb END AS rank FROM {y}_v WHERE len(list_filter(va, lambda a: len(list_filter(vb, lambda b: greatest(a.v, b.v) / least(a.v, b.v) > 2 AND a.year = b.year)) > 0)) > 0),
        {y}_m AS (SELECT {x}.*, d.rank IS NOT NULL AS gone FROM {x} LEFT JOIN {y}_d d ON d.query_id = {x}.query_id AND d.rank = {x}.rank), {y} AS (SELECT * EXCLUDE (gone) FROM (SELECT *, bool_and(gone) OVER (PARTITION BY query_id) AS every FROM {y}_m) WHERE NOT gone OR every)""".replace("* EXCLUDE (gone)", "* EXCLUDE (gone, every)")


def _covered(x: str, y: str) -> str:
    return f", {y}_e AS (SELECT {x}.query_id, rank, e FROM {x} JOIN cn USING (chunk_id) WHERE len(e) > 0), {y} AS (SELECT * FROM {x} WHERE NOT EXISTS (SELECT 1 FROM {y}_e a JOIN {y}_e b ON a.query_id = b.query_id AND a.rank < b.rank WHERE b.query_id = {x}.query_id AND b.rank = {x}.rank AND list_has_all(a.e, b.e)))"


_PW = lambda c: f"' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' '"
_WD = lambda w: f"contains(pw, {_PW(w)})"
_PS = r"list_filter(regexp_split_to_array(n, '\s+'), lambda p: p <> '')"
_RS = f"list_filter({_PS}, lambda p: length(p) >= 3 AND lower(p) NOT IN ({_qs(QUERY_STOPS)}))"
_HIT = f"""CASE WHEN len({_PS}) > 1 THEN contains(low, lower(n)) OR len(list_filter({_PS}, lambda p: length(p) >= 8 AND {_WD('p')})) > 0 OR (len({_RS}) > 0 AND len(list_filter({_RS}, lambda p: NOT {_WD('p')})) = 0) ELSE len(list_filter({_PS}, lambda p: length(p) >= 5 AND {_WD('p')})) > 0 END"""


def _tiered(x: str, y: str) -> str:
    return f""", {y}_a AS (SELECT {x}.*, coalesce(entities, []::VARCHAR[]) AS entities, lower(text) AS low, {_PW('text')} AS pw, list_filter(list_filter(coalesce(words, []), lambda w: length(w) >= 4), lambda w: NOT list_contains(flatten(list_transform(coalesce(entities, []::VARCHAR[]), lambda n: regexp_extract_all(lower(n), '[a-z0-9]+'))), w)) AS content FROM {x} LEFT JOIN ak USING (query_id)),
        {y}_b AS (SELECT *, len(list_filter(content, lambda w: {_WD('w')})) AS shared FROM {y}_a),
        {y}_c AS (SELECT *, CASE WHEN len(entities) = 0 OR len(list_filter(entities, lambda n: ({_HIT}) AND (len({_PS}) > 1 OR length(n) >= 8))) > 0 THEN 0 WHEN len(list_filter(entities, lambda n: {_HIT})) > 0 OR (len(content) > 0 AND shared >= 2 AND shared / len(content) >= 0.5) THEN 1 ELSE 2 END AS tier FROM {y}_b),
        {y}_k AS (SELECT *, tier < 2 OR rank <= 2 AS keep FROM {y}_c), {y}_n AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY query_id) AS n_keep, row_number() OVER (PARTITION BY query_id, keep ORDER BY rank) AS i FROM {y}_k),
        {y} AS (SELECT * EXCLUDE (entities, low, pw, content, shared, keep, n_keep, i), row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS place FROM {y}_n WHERE keep OR i <= 5 - n_keep)"""


def _capped(x: str, y: str) -> str:
    return f", {y}_g AS (SELECT *, row_number() OVER (PARTITION BY query_id, best_sub_query ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, best_sub_query) AS lead FROM {x}), {y} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, lead, rank) AS place FROM {y}_g QUALIFY place <= {BUDGET})"


_SPL = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '')"
_NMD = "len(list_filter(entities, lambda n: contains(lower(p), lower(n)))) > 0"
_ORD = f"list_concat(list_filter({_SPL}, lambda p: {_NMD}), list_filter({_SPL}, lambda p: NOT ({_NMD})))"
_SHR = f"CASE WHEN length(text) <= {SHRINK} THEN text ELSE array_to_string({_ORD}[1:coalesce(list_position(list_transform({_ORD}, lambda p, i: i > 1 AND list_sum(list_transform({_ORD}[1:i - 1], lambda z: length(z) + 1)) + length(p) > {SHRINK}), TRUE) - 1, len({_ORD}))], ' ') END"
_PIC = f"list_reduce(list_sort(list_transform({_SPL}, lambda p, i: {{'s': -len(list_intersect(words, regexp_extract_all(lower(p), '[a-z0-9]+'))), 'i': i, 'p': p}})), lambda a, x: CASE WHEN coalesce(list_sum(list_transform(a, lambda z: length(z.p) + 1)), 0) + length(x.p) + 1 <= {SHRINK} THEN list_append(a, {{'i': x.i, 'p': x.p}}) ELSE a END, []::STRUCT(i BIGINT, p VARCHAR)[])"
_CUT = f"CASE WHEN length(text) <= {SHRINK} THEN text ELSE coalesce(nullif(array_to_string(list_transform(list_sort({_PIC}), lambda z: z.p), ' '), ''), substring(text, 1, {SHRINK})) END"
ORACLE = {
    "f03_relevance": _CLS + _PH + ", " + _T.removeprefix("WITH ") + _relevant("kt", "y") + " SELECT query_id, chunk_id, rank FROM y",
    "f04_redundancy": _T + _redundant("kt", "y") + " SELECT query_id, chunk_id, rank FROM y",
    "f06_contradiction": _T + _contradicting("kt", "y") + " SELECT query_id, chunk_id, rank FROM y",
    "f07_entity_overlap": _T + _CN + _covered("kt", "y") + " SELECT query_id, chunk_id, rank FROM y",
    "f08_entity_tiers": _T + _ASK + _tiered("kt", "y") + " SELECT query_id, chunk_id, tier, place FROM y",
    "f09_fair_cap": _T + _SUB + _capped("bs", "y") + " SELECT query_id, chunk_id, best_sub_query, place FROM y",
    "f01_navigate": _CLS + _PH + ", " + _T.removeprefix("WITH ") + _SUB + _CN + _ASK + _relevant("bs", "n1") + _redundant("n1", "n2") + _contradicting("n2", "n3") + _covered("n3", "n4") + _tiered("n4", "n5") + ", n6 AS (SELECT * EXCLUDE (rank, place), place AS rank FROM n5)" + _capped("n6", "n7")
    + f" SELECT query_id, place, chunk_id, best_sub_query, tier, {_SHR} AS text FROM (SELECT n7.*, coalesce(ak.entities, []::VARCHAR[]) AS entities FROM n7 LEFT JOIN ak USING (query_id))",
    "f11_context": _T + _ASK + f""", hw AS (SELECT kt.query_id, rank, w FROM kt JOIN (SELECT query_id, unnest(words) AS w FROM ak) q ON q.query_id = kt.query_id WHERE contains(lower(text), w)), hd AS (SELECT query_id, w, count(*) AS df FROM hw GROUP BY 1, 2), hn AS (SELECT query_id, count(*) AS n FROM kt GROUP BY 1),
        hs AS (SELECT hw.query_id, rank, sum(CASE WHEN n >= 4 THEN ln((n + 1) / (df + 0.5::DOUBLE)) ELSE 1 END) AS s FROM hw JOIN hd USING (query_id, w) JOIN hn USING (query_id) GROUP BY 1, 2),
        ho AS (SELECT kt.*, round(coalesce(s, 0) / sqrt(greatest(1, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda z: z <> '')))), 9) AS sc FROM kt LEFT JOIN hs USING (query_id, rank)),
        hp AS (SELECT ho.query_id, chunk_id, text, row_number() OVER (PARTITION BY ho.query_id ORDER BY sc DESC, rank) AS place, coalesce(entities, []::VARCHAR[]) AS entities, coalesce(words, []::VARCHAR[]) AS words FROM ho LEFT JOIN ak USING (query_id))
        SELECT query_id, chunk_id, place, {_SHR} AS shrunk, {_CUT} AS cut FROM hp""",
    "f05_jaccard_to_first": _T + r""", z AS (SELECT query_id, rank, chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS t FROM kt)
        SELECT z.query_id, z.chunk_id, round(CASE WHEN len(z.t) = 0 OR len(f.t) = 0 THEN 0 ELSE len(list_intersect(z.t, f.t)) / (len(z.t) + len(f.t) - len(list_intersect(z.t, f.t))) END::DOUBLE, 6) AS overlap FROM z JOIN z f ON f.query_id = z.query_id AND f.rank = 1""",
    "f12_hop_merge": _T + """, h AS (SELECT query_id, count(DISTINCT hop_distance) AS n FROM k GROUP BY 1), g AS (SELECT k.*, n, row_number() OVER (PARTITION BY query_id, hop_distance ORDER BY rank) AS i FROM k JOIN h USING (query_id)),
        j AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN i <= floor(8 / n) THEN 0 ELSE 1 END, rank) <= 8) SELECT query_id, chunk_id, hop_distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM j""",
    "f15_prompt_context": _T + f""", ln2 AS (SELECT query_id, rank, '[' || rank || '] ' || text AS line FROM kt WHERE rank <= {MAX_DOCS}), u AS (SELECT * FROM ln2 QUALIFY sum(length(line)) OVER (PARTITION BY query_id ORDER BY rank) <= {CHAR_BUDGET})
        SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS context, count(*) AS n_chunks FROM u GROUP BY 1""",
    "f16_retrieval_confidence": _T + ", " + _QE + """, en2 AS (SELECT query_id, list(DISTINCT lower(key)) AS e FROM qk GROUP BY 1), cf2 AS (SELECT query_id, max(rrf) FILTER (rank = 1) AS a, max(rrf) FILTER (rank = 2) AS b, bool_or(method = 'hybrid') FILTER (rank = 1) AS h, string_agg(lower(text), ' ' ORDER BY rank) FILTER (rank <= 3) AS tx FROM kt GROUP BY 1)
        SELECT query_id, CASE WHEN b IS NULL THEN 'low' WHEN (a / greatest(b, 0.000001) >= 1.5)::INT + h::INT + coalesce(len(list_filter(e, lambda x: NOT contains(tx, x))) = 0, FALSE)::INT >= 2 THEN 'high'
            WHEN (a / greatest(b, 0.000001) >= 1.5)::INT + h::INT + coalesce(len(list_filter(e, lambda x: NOT contains(tx, x))) = 0, FALSE)::INT = 1 THEN 'medium' ELSE 'low' END AS level FROM cf2 LEFT JOIN en2 USING (query_id)""",
}
