"""Retrieval lanes, fusion and ranked-list evaluation; every operator takes a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.functions.metrics import dcg_at, ndcg_at, norm_title, recall_at, reciprocal_rank
from lanefold.functions.text import LEXICAL, LEXICAL_STOPS, lexical_tokens, strip, strip_sql
from lanefold.operators.skew import attach, numbered
from lanefold.plans.settings import DEFAULTS, cell
from lanefold.sources.shared import load, materialise

K1, B, IDF_FLOOR = 1.5, 0.75, 0.25
RRF_K, BOOST, TOP_K = 60, 1.2, 20
LANES = ("vector", "graph", "bm25")
QUERY_BLOCK = 4096
PART_POSTINGS = 50_000


# --- lexical lane ---------------------------------------------------------------------------------------------------


def tokens_of(rows: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(name, term): every lexical token of every text; stop words are dropped behind the explode, inside generated code."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({LEXICAL})"), F.lit(1))
    return rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(name), F.explode(found).alias("term")).where(~F.col("term").isin(LEXICAL_STOPS))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf) of a corpus."""
    return tokens_of(docs, id_col, text_col, "doc").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) of postings and a one-row table (n); negative idf becomes a quarter of the mean idf."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, IDF_FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def texts_counted(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).agg(F.count(F.lit(1)).alias("n"))


def bm25_topk(queries: DataFrame, docs: DataFrame, qid: str, qtext: str, did: str, dtext: str, k: int = TOP_K, post: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank), scores divided by the query's best, positive ones only.

    Only postings of terms that a query holds are moved. A term's postings are dealt to one part per PART_POSTINGS of
    them and its queries copied to these parts, so no task holds all documents of a frequent term. Ties by doc id on the
    rounded score. Null texts match nothing; repeated query terms count repeatedly. ``post`` may hold the postings.
    """
    q = tokens_of(queries, qid, qtext, "query_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    post = materialise(postings(docs, did, dtext), "postings") if post is None else post
    n_docs = texts_counted(docs, dtext)
    wanted = q.select("term").distinct()
    held = materialise(bm25_index(post, n_docs).join(wanted, "term", "left_semi").withColumn("parts", F.ceil(F.col("df") / PART_POSTINGS).cast("int")), "query-terms")
    lengths = post.groupBy("doc").agg(F.sum("tf").alias("dl"))
    stats = lengths.agg(F.sum("dl").alias("total")).crossJoin(n_docs).select((F.col("total") / F.col("n")).alias("avgdl"))
    total = held.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    hits = attach(post, held, "term", "df", total).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))).join(lengths, "doc")
    asked = q.join(held.select("term", "parts"), "term").select("query_id", "term", "times", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = asked.join(hits, ["term", "part"]).crossJoin(F.broadcast(stats)).groupBy("query_id", F.col("doc").alias("doc_id")).agg(F.sum(weight).alias("raw"))
    scored = materialise(scored, "lexical-scores")
    best = scored.groupBy("query_id").agg(F.max("raw").alias("best"))
    score = F.round(F.col("raw") / F.col("best"), 6)
    ranked = scored.join(best, "query_id").where((F.col("raw") > 0)).select("query_id", "doc_id", score.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- dense lane -----------------------------------------------------------------------------------------------------


def unit(v: np.ndarray) -> np.ndarray:
    """Rows divided by their norm; a zero row stays."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def dense_topk(queries: DataFrame, corpus: DataFrame, qid: str, did: str, vec: str, k: int = TOP_K, threshold: float = 0.0, metric: str = "cosine") -> DataFrame:
    """Exact (query_id, doc_id, similarity, rank), of at least threshold.

    The similarity is the cosine clamped to [0, 1], or 1 / (1 + distance) with the metric "l2". Queries are numbered by the
    tasks and sent in blocks of QUERY_BLOCK (R13: bounded by the block, not the table); each task keeps the best k of its
    rows per query before anything is shuffled. Null vectors take no part; ties by doc id on the rounded similarity.
    """
    spark = corpus.sparkSession
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(qid).alias("_q"), F.col(vec).alias("_v"), F.lit(1).alias("_one"))
    asked = numbered(asked, ["_one"], {"_o": F.col("_q")})
    asked = materialise(asked.select("_q", "_v", F.floor((F.col("_place") - 1) / QUERY_BLOCK).alias("block")), "query-blocks")
    last = asked.agg(F.max("block")).first()[0]
    found = None
    for at in range(0 if last is None else last + 1):
        block = asked.where(F.col("block") == at).toPandas()
        held = spark.sparkContext.broadcast((block["_q"].to_numpy(), np.array(block["_v"].tolist(), np.float64)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, q = held.value
            u = unit(q)
            for b in batches:
                if not len(b):
                    continue
                x = np.array(b[vec].tolist(), np.float64)
                if metric == "l2":
                    apart = np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T)
                    sims = np.round(1 / (1 + np.sqrt(apart)), 6)
                else:
                    sims = np.round(np.clip(u @ unit(x).T, 0, 1), 6)
                docs = b[did].to_numpy()
                order = np.lexsort((np.broadcast_to(docs, sims.shape), -sims), axis=1)[:, :k]
                i = np.repeat(np.arange(len(q)), order.shape[1])
                j = order.ravel()
                yield pd.DataFrame({"query_id": names[i], "doc_id": docs[j], "similarity": sims[i, j]})

        part = corpus.where(F.col(vec).isNotNull()).select(did, vec).mapInPandas(run, "query_id long, doc_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, doc_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.where(F.col("similarity") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- fusion ---------------------------------------------------------------------------------------------------------


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged lanes, repeated rows once: query_id, chunk_id, source_doc, hop_distance (-1 if none) and each lane's rank and score."""
    r = load(spark, sf_dir, "retrieval_results").where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull())
    cols = [c for lane in LANES for c in (f"{lane}_rank", f"{lane}_score")]
    return r.groupBy("query_id", "chunk_id").agg(F.max("source_doc").alias("source_doc"), F.coalesce(F.max("hop_distance"), F.lit(-1)).alias("hop_distance"), *[(F.min if c.endswith("rank") else F.max)(c).alias(c) for c in cols])


def rrf(rows: DataFrame, weights: dict[str, Column], boost: Column, k: int = RRF_K) -> DataFrame:
    """Rows with rrf (weighted sum of 1 / (k + rank), plus one bonus when in two lanes or more) and method.

    A lane of weight 0 is left out altogether, also for the bonus.
    """
    present = {lane: F.col(f"{lane}_rank").isNotNull() & (w > 0) for lane, w in weights.items()}
    score = sum((F.when(present[lane], w / (k + F.col(f"{lane}_rank"))).otherwise(F.lit(0.0)) for lane, w in weights.items()), F.lit(0.0))
    n = sum((p.cast("int") for p in present.values()), F.lit(0))
    first = F.when(present["vector"], "vector").when(present["bm25"], "bm25").otherwise("graph")
    return rows.where(n > 0).withColumn("rrf", F.round(score + F.when(n >= 2, boost / (k + 1)).otherwise(F.lit(0.0)), 9)).withColumn("method", F.when(n >= 2, "hybrid").otherwise(first))


def top(rows: DataFrame, by: str, keys: list[str], k: int, tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each key, with rank; ties by ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _weights(v: float, g: float, b: float) -> dict[str, Column]:
    return {"vector": F.lit(v), "graph": F.lit(g), "bm25": F.lit(b)}


def r08_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = rrf(lanes(spark, sf_dir), _weights(1.0, 1.0, 1.0), F.lit(BOOST))
    return top(fused, "rrf", ["query_id"], TOP_K).select("query_id", "chunk_id", "rrf", "method", "rank", "source_doc", "hop_distance")


def configured(spark: SparkSession, sf_dir: str, settings: dict) -> DataFrame:
    """The fused lists under settings: mode, weights, whether the lexical lane runs, smoothing, bonus and length.

    Mode "vector" or "graph" leaves the other lanes out; an unknown mode raises ValueError.
    """
    rag, mode = settings["rag"], settings["rag"]["retrieval_mode"]
    if mode not in ("vector", "graph", "hybrid"):
        raise ValueError(f"unknown retrieval mode: {mode}")
    on = {"vector": mode != "graph", "graph": mode != "vector", "bm25": mode == "hybrid" and rag["enable_bm25"]}
    weights = _weights(*[rag[f"{lane}_weight"] if on[lane] else 0.0 for lane in LANES])
    fused = rrf(lanes(spark, sf_dir), weights, F.lit(rag["cross_source_boost"]), rag["rrf_k"])
    return top(fused, "rrf", ["query_id"], settings["vector_store"]["top_k_vectors"])


#: the settings of the r14 query: a narrower list, a weaker graph lane and less smoothing than the defaults
R14_CHANGES = {"rag.graph_weight": 0.5, "rag.rrf_k": 30, "rag.cross_source_boost": 1.5, "vector_store.top_k_vectors": 10}


def r14_configured_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configured(spark, sf_dir, cell(DEFAULTS, R14_CHANGES)).select("query_id", "chunk_id", "rrf", "method", "rank")


#: Lane presets as weights of vector, graph and lexical lane. R10: a graph weight without a vector weight means
#: graph mode, which leaves the lexical lane out; no weight of either means the lexical lane alone.
PRESETS = {"dense": (1.0, 0.0, 0.0), "bm25": (0.0, 0.0, 1.0), "graph": (0.0, 1.0, 0.0), "hybrid": (1.0, 1.0, 1.0), "hybrid_005": (1.0, 0.05, 1.0)}


def presets(rows: DataFrame, weights: dict[str, tuple[float, float, float]], boosts: tuple[float, ...] = (BOOST,)) -> DataFrame:
    """Every row under every preset and boost, fused in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(v).alias("wv"), F.lit(g).alias("wg"), F.lit(b).alias("wb"), F.lit(x).alias("beta")) for n, (v, g, b) in weights.items() for x in boosts]))
    rows = rows.select("*", cells.alias("cell")).select("*", "cell.*").drop("cell")
    return rrf(rows, {"vector": F.col("wv"), "graph": F.col("wg"), "bm25": F.col("wb")}, F.col("beta"))


def r15_lane_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = presets(lanes(spark, sf_dir), PRESETS)
    return top(fused, "rrf", ["preset", "query_id"], 10).select("preset", "query_id", "chunk_id", "rrf", "method", "rank")


def r11_dense_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes(spark, sf_dir).where(F.col("vector_rank").isNotNull()).withColumn("score", -F.col("vector_rank"))
    return top(rows, "score", ["query_id"], TOP_K).select("query_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "rank")


def r12_graph_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph lane alone, its confidence not below 0."""
    rows = lanes(spark, sf_dir).where(F.col("graph_rank").isNotNull()).withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("graph_score")), 6))
    return top(rows, "score", ["query_id"], TOP_K).select("query_id", "chunk_id", "score", "hop_distance", "rank")


def r09_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense lane with one row per first 80 characters of text, ranked anew."""
    texts = load(spark, sf_dir, "chunk_extractions").groupBy("chunk_id").agg(F.max("text").alias("text"))
    rows = lanes(spark, sf_dir).where(F.col("vector_rank").isNotNull()).select("query_id", "chunk_id", "vector_rank").join(texts, "chunk_id", "left")
    same = Window.partitionBy("query_id", F.substring(F.coalesce("text", F.col("chunk_id")), 1, 80)).orderBy("vector_rank", "chunk_id")
    kept = rows.withColumn("i", F.row_number().over(same)).where("i = 1").withColumn("score", -F.col("vector_rank"))
    return top(kept, "score", ["query_id"], 10**9).select("query_id", "chunk_id", "rank")


def f02_subquery_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02 with the lanes as sub-queries: 0-based ranks by score, times 1 + 0.1 (sources - 1) + 0.05 (sub-queries - 1)."""
    sides = F.explode(F.array(*[F.struct(F.lit(lane).alias("sub_query"), F.col(f"{lane}_score").alias("score")) for lane in LANES]))
    rows = lanes(spark, sf_dir).select("query_id", "chunk_id", "source_doc", sides.alias("x")).select("query_id", "chunk_id", "source_doc", "x.*").where(F.col("score").isNotNull() & ~F.isnan("score"))
    w = Window.partitionBy("query_id", "sub_query").orderBy(F.desc("score"), "chunk_id")
    rows = rows.withColumn("place", F.row_number().over(w) - 1)
    g = rows.groupBy("query_id", "chunk_id").agg(F.sum(1 / (RRF_K + F.col("place"))).alias("s"), F.countDistinct("source_doc").alias("sources"), F.countDistinct("sub_query").alias("subs"), F.min(F.struct("place", "sub_query"))["sub_query"].alias("best_sub_query"))
    return g.select("query_id", "chunk_id", F.round(F.col("s") * (1 + 0.1 * (F.greatest("sources", F.lit(1)) - 1) + 0.05 * (F.col("subs") - 1)), 9).alias("rrf"), "best_sub_query")


def a09_boost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cross-lane boost, how often the first chunk stands in two lanes or more."""
    fused = top(presets(lanes(spark, sf_dir), {"hybrid": PRESETS["hybrid"]}, (1.0, 1.1, 1.2, 1.5, 2.0)), "rrf", ["beta", "query_id"], 1)
    return fused.groupBy("beta").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg((F.col("method") == "hybrid").cast("int")), 6).alias("hybrid_first"), F.round(F.avg("rrf"), 6).alias("mean_rrf"))


def a11_graph_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, source) pairs that only the graph lane returned."""
    r = lanes(spark, sf_dir).where(F.col("source_doc").isNotNull())
    g = r.where(F.col("graph_rank").isNotNull()).select("query_id", "source_doc").distinct()
    return g.join(r.where(F.col("vector_rank").isNotNull() | F.col("bm25_rank").isNotNull()), ["query_id", "source_doc"], "left_anti")


def a12_rescue_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries with a rescued source, by question type."""
    types = load(spark, sf_dir, "agentic_ablation").groupBy(F.col("question_id").alias("query_id")).agg(F.max("question_type").alias("question_type"))
    rescued = a11_graph_rescued(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    q = lanes(spark, sf_dir).select("query_id").distinct().join(types, "query_id", "left").join(rescued, "query_id", "left")
    return q.groupBy("question_type").agg(F.count(F.lit(1)).alias("n_queries"), F.count("n").alias("n_rescued"), F.round(F.count("n") / F.count(F.lit(1)), 6).alias("rescue_rate"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sources"))


def a50_crowd_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per query and source, most first, with the source's share of the list."""
    r = lanes(spark, sf_dir)
    n = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    per = r.groupBy("query_id", "source_doc").agg(F.count(F.lit(1)).alias("n"))
    return per.join(n, "query_id").select("query_id", "source_doc", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def a52_source_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank of every source in every lane; null where the lane missed it."""
    return lanes(spark, sf_dir).groupBy("query_id", "source_doc").agg(*[F.min(f"{lane}_rank").cast("double").alias(f"{lane}_rank") for lane in LANES])


def a07_lane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lane, queries served, mean list length, mean overlap with the fused ten best, and mean supporting-fact metrics."""
    r = lanes(spark, sf_dir)
    best = r08_rrf_fusion(spark, sf_dir).where("rank <= 10").select("query_id", "chunk_id", F.lit(1).alias("hit"))
    sides = F.explode(F.array(*[F.struct(F.lit(lane).alias("lane"), F.col(f"{lane}_rank").alias("lane_rank")) for lane in LANES]))
    rows = r.select("query_id", "chunk_id", sides.alias("x")).select("query_id", "chunk_id", "x.*").where(F.col("lane_rank").isNotNull()).join(best, ["query_id", "chunk_id"], "left")
    per = rows.groupBy("lane", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    served = per.groupBy("lane").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.avg(F.col("hits") / 10), 6).alias("recall_of_fused_10"))
    lists = r.select("query_id", "source_doc", sides.alias("x")).where(F.col("x.lane_rank").isNotNull()).select("query_id", "source_doc", F.col("x.lane").alias("lane"))
    sf = supporting_metrics(titled(lists, ["lane", "query_id"]), gold_titles(spark, sf_dir), ["lane", "query_id"])
    return served.join(sf.groupBy("lane").agg(*[F.round(F.avg(c), 5).alias(f"sf_{c}") for c in ("precision", "recall", "f1")]), "lane", "left")


def d16_lane_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources among the ten best that appear only with, or only without, the graph lane."""
    f = presets(lanes(spark, sf_dir), {"with": (1.0, 1.0, 1.0), "without": (1.0, 0.0, 1.0)})
    t = top(f, "rrf", ["preset", "query_id"], 10).groupBy("query_id", "source_doc").agg(F.max((F.col("preset") == "with").cast("int")).alias("w"), F.max((F.col("preset") == "without").cast("int")).alias("o"))
    return t.where("w + o = 1").select("query_id", "source_doc", F.when(F.col("w") == 1, "gained").otherwise("lost").alias("change"))


def r05_lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    t = lexical_tokens(F.col("text"))
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def r06_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return bm25_index(postings(d, "doc_id", "text"), texts_counted(d, "text")).withColumn("idf", F.round("idf", 6))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(load(spark, sf_dir, "eval_items"), load(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


def r01_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    e = load(spark, sf_dir, "embeddings")
    return dense_topk(e.where(F.col("vec_id") % 100 == 0), e, "vec_id", "vec_id", "embedding")


def r02_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R02 with the Euclidean metric, over the same queries."""
    e = load(spark, sf_dir, "embeddings")
    return dense_topk(e.where(F.col("vec_id") % 100 == 0), e, "vec_id", "vec_id", "embedding", metric="l2")


def r03_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared norm of every usable chunk vector before and after normalisation, zero rows guarded."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = load(spark, sf_dir, "chunk_vectors").select("chunk_id", "embedding").distinct().where(F.size("embedding") == 64).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    after = F.aggregate(F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)), F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("chunk_id", F.round(norm, 3).alias("norm"), F.round(after, 6).alias("norm_after"))


def gold_documents(spark: SparkSession, sf_dir: str, post: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that contain an item's text, whatever its case.

    A document that contains the text has all of its inner tokens, so candidates are the postings of the inner token with
    the fewest documents; these are then compared in full. Items without three tokens have no gold.
    """
    items = load(spark, sf_dir, "eval_items").where(F.length("text") > 0).select("item_id", F.lower("text").alias("passage"))
    t = lexical_tokens(F.col("passage"))
    whole = F.regexp_extract_all("passage", F.lit(f"({LEXICAL})"), F.lit(1))
    inner = items.where(F.size(whole) >= 3).select("item_id", "passage", F.explode(F.filter(F.array_distinct(F.slice(whole, 2, F.size(whole) - 2)), lambda x: ~x.isin(LEXICAL_STOPS))).alias("term"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = inner.join(df, "term").groupBy("item_id", "passage").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    docs = load(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("low"))
    near = rarest.join(post.select(F.col("doc").alias("doc_id"), "term"), "term").select("item_id", "passage", "doc_id")
    return near.join(docs, "doc_id").where(F.col("low").contains(F.col("passage"))).select("item_id", "doc_id").distinct()


def a51_answer_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks among each question's results whose text holds the gold answer, whatever its case."""
    gold = load(spark, sf_dir, "agentic_ablation").groupBy(F.col("question_id").alias("query_id")).agg(F.max("gold_answer").alias("gold"))
    texts = load(spark, sf_dir, "chunk_extractions").groupBy("chunk_id").agg(F.lower(F.max("text")).alias("low"))
    rows = lanes(spark, sf_dir).select("query_id", "chunk_id").join(gold.where(F.length(strip(F.col("gold"))) > 0), "query_id").join(texts, "chunk_id")
    return rows.where(F.col("low").contains(F.lower(strip(F.col("gold"))))).select("query_id", "chunk_id")


def gold_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, title): normalised titles of the sources that support a question's gold answer, once each.

    The tables list no supporting facts; the sources of the answer-bearing chunks that any lane returned stand for them.
    """
    sources = lanes(spark, sf_dir).select("query_id", "chunk_id", "source_doc")
    return titled(a51_answer_bearing(spark, sf_dir).join(sources, ["query_id", "chunk_id"]), ["query_id"])


def titled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct normalised titles of each list's sources."""
    return rows.where(F.col("source_doc").isNotNull()).select(*keys, norm_title(F.col("source_doc")).alias("title")).where(F.col("title") != "").distinct()


def supporting_metrics(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, n_gold, n_retrieved, precision, recall, f1, all_gold, for every list whose question has gold titles."""
    wanted = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = found.join(gold.withColumn("hit", F.lit(1)), ["query_id", "title"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_retrieved"), F.count("hit").alias("n_hits"))
    m = hits.join(wanted, "query_id")
    p, r = F.col("n_hits") / F.col("n_retrieved"), F.col("n_hits") / F.col("n_gold")
    f1 = F.when(F.col("n_hits") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return m.select(*keys, "n_gold", "n_retrieved", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), (F.col("n_hits") == F.col("n_gold")).alias("all_gold"))


def m04_gold_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_titles(spark, sf_dir)


def m07_supporting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M06, M07 over the fused list of every question."""
    return supporting_metrics(titled(r08_rrf_fusion(spark, sf_dir), ["query_id"]), gold_titles(spark, sf_dir), ["query_id"])


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, ranked (documents of the lexical lane in order), gold; judged items only."""
    docs = load(spark, sf_dir, "documents")
    post = materialise(postings(docs, "doc_id", "text"), "postings")
    lane = bm25_topk(load(spark, sf_dir, "eval_items"), docs, "item_id", "text", "doc_id", "text", post=post)
    ranked = lane.groupBy(F.col("query_id").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ranked"))
    gold = gold_documents(spark, sf_dir, post).groupBy("item_id").agg(F.collect_set("doc_id").alias("gold"))
    return gold.join(ranked, "item_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<bigint>")))


def m09_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M09 to M12 for every judged item."""
    r, g = F.col("ranked"), F.col("gold")
    return judged(spark, sf_dir).select("item_id", F.round(recall_at(r, g, 10), 6).alias("recall_10"), F.round(dcg_at(r, g, 10), 6).alias("dcg_10"), F.round(ndcg_at(r, g, 10), 6).alias("ndcg_10"), F.round(reciprocal_rank(r, g), 6).alias("rr"))


def a01_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g = F.col("ranked"), F.col("gold")
    cols = [F.round(F.avg(recall_at(r, g, k)), 6).alias(f"recall_{k}") for k in (5, 10, 20)] + [F.round(F.avg(ndcg_at(r, g, k)), 6).alias(f"ndcg_{k}") for k in (5, 10, 20)]
    return judged(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_judged"), F.round(F.avg(reciprocal_rank(r, g)), 6).alias("mrr"), *cols)


def s20_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per source file, from the chunk table, with the first and last chunk id."""
    c = load(spark, sf_dir, "chunk_extractions")
    return c.groupBy("source_file").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


QUERIES = {f.__name__: f for f in (
    r01_dense_topk, r02_l2_topk, r03_normalised, r05_lexical_tokens, r06_term_index, r08_rrf_fusion, r09_fingerprint_dedup, r11_dense_only, r12_graph_only, r14_configured_fusion, r15_lane_presets, f02_subquery_fusion,
    a01_ir_metrics, a07_lane_summary, a09_boost_sweep, a11_graph_rescued, a12_rescue_by_type, a50_crowd_out, a51_answer_bearing, a52_source_ranks, d16_lane_contrast, m04_gold_titles, m07_supporting_facts, m09_ranking_metrics, s20_source_rows,
)} | {"r07_bm25_topk": bm25}

_STOP = "[" + ", ".join(f"'{w}'" for w in LEXICAL_STOPS) + "]"
_TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[''’][a-z]+)?'), lambda t: NOT list_contains(" + _STOP + ", t))"
_IDX = f"""WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
    f AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    w AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM f, n), i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM w) ELSE raw END AS idf FROM w)"""
_BM = _IDX + f""", q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM eval_items) GROUP BY 1, 2),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
    s AS (SELECT item_id AS query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))) AS raw FROM q JOIN i USING (term) JOIN tf USING (term), n GROUP BY 1, 2),
    x AS (SELECT query_id, doc_id, raw, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM s),
    b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE raw > 0 QUALIFY rank <= 20)"""
_TITLE = "trim(regexp_replace(regexp_replace(lower(trim({c})), '^[^ _]+_(.)', '\\1'), '\\s+', ' ', 'g'))"
_BEAR = f"""gq AS (SELECT question_id AS query_id, max(gold_answer) AS gold FROM agentic_ablation GROUP BY 1), gx AS (SELECT chunk_id, lower(max(text)) AS low FROM chunk_extractions GROUP BY 1),
    ab AS (SELECT query_id, chunk_id, source_doc FROM r JOIN gq USING (query_id) JOIN gx USING (chunk_id) WHERE {strip_sql('gold')} <> '' AND contains(low, lower({strip_sql('gold')})))"""
_SF = f", {_BEAR}, gt AS (SELECT DISTINCT query_id, title FROM (SELECT query_id, {_TITLE.format(c='source_doc')} AS title FROM ab WHERE source_doc IS NOT NULL) WHERE title <> ''), gn AS (SELECT query_id, count(*) AS n_gold FROM gt GROUP BY 1)"


def _sf_sql(rows: str, keys: str) -> str:
    """CTE sm: supporting-fact metrics of the lists in ``rows`` by ``keys``."""
    return f""", tl AS (SELECT DISTINCT {keys}, {_TITLE.format(c='source_doc')} AS title FROM ({rows}) WHERE source_doc IS NOT NULL), th AS (SELECT {keys}, count(*) AS n_retrieved, count(gt.title) AS h FROM tl LEFT JOIN gt USING (query_id, title) WHERE tl.title <> '' GROUP BY ALL),
    sm AS (SELECT {keys}, n_gold, n_retrieved, round(h / n_retrieved, 6) AS precision, round(h / n_gold, 6) AS recall, round(CASE WHEN h > 0 THEN 2 * (h / n_retrieved) * (h / n_gold) / (h / n_retrieved + h / n_gold) ELSE 0 END::DOUBLE, 6) AS f1, h = n_gold AS all_gold FROM th JOIN gn USING (query_id))"""


_GOLD = "SELECT DISTINCT item_id, doc_id FROM eval_items e JOIN documents d ON contains(lower(d.text), lower(e.text)) WHERE len(regexp_extract_all(lower(e.text), '[a-z0-9]+(?:[''’][a-z]+)?')) >= 3"
_JUDGE = _BM + f""", gold AS ({_GOLD}), g AS (SELECT item_id, list(DISTINCT doc_id) AS gold FROM gold GROUP BY 1), r AS (SELECT query_id AS item_id, list(doc_id ORDER BY rank) AS ranked FROM b GROUP BY 1),
    j AS (SELECT item_id, gold, coalesce(ranked, []) AS ranked FROM g LEFT JOIN r USING (item_id)),
    h AS (SELECT item_id, gold, unnest(range(1, 21)) AS i, ranked FROM j), v AS (SELECT item_id, i, gold, coalesce(list_contains(gold, ranked[i]), FALSE)::INT AS hit FROM h),
    m AS (SELECT item_id, """ + ", ".join(
    f"sum(hit) FILTER (i <= {k}) / len(any_value(gold)) AS recall_{k}, sum(hit / log2(i + 1)) FILTER (i <= {k}) AS dcg_{k}, sum(hit / log2(i + 1)) FILTER (i <= {k}) / sum(1 / log2(i + 1)) FILTER (i <= least(len(gold), {k})) AS ndcg_{k}" for k in (5, 10, 20)
) + ", coalesce(1 / min(i) FILTER (hit = 1), 0) AS rr FROM v GROUP BY 1)"
_L = """WITH r AS (SELECT query_id, chunk_id, max(source_doc) AS source_doc, coalesce(max(hop_distance), -1) AS hop_distance, min(vector_rank) AS vector_rank, max(vector_score) AS vector_score, min(graph_rank) AS graph_rank,
    max(graph_score) AS graph_score, min(bm25_rank) AS bm25_rank, max(bm25_score) AS bm25_score FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2)"""


def _rrf_sql(cells: str) -> str:
    """CTE f: rows of r under the cells (preset, wv, wg, wb, beta), fused."""
    return f""", c(preset, wv, wg, wb, beta) AS (VALUES {cells}), l AS (SELECT r.*, c.*, vector_rank IS NOT NULL AND wv > 0 AS iv, graph_rank IS NOT NULL AND wg > 0 AS ig, bm25_rank IS NOT NULL AND wb > 0 AS ib FROM r, c),
    f AS (SELECT *, round(CASE WHEN iv THEN wv / (60 + vector_rank) ELSE 0 END + CASE WHEN ig THEN wg / (60 + graph_rank) ELSE 0 END + CASE WHEN ib THEN wb / (60 + bm25_rank) ELSE 0 END
        + CASE WHEN iv::INT + ig::INT + ib::INT >= 2 THEN beta / 61 ELSE 0 END, 9) AS rrf, CASE WHEN iv::INT + ig::INT + ib::INT >= 2 THEN 'hybrid' WHEN iv THEN 'vector' WHEN ib THEN 'bm25' ELSE 'graph' END AS method FROM l WHERE iv OR ig OR ib),
    t AS (SELECT *, row_number() OVER (PARTITION BY preset, beta, query_id ORDER BY rrf DESC, chunk_id) AS rank FROM f)"""


def _cells(weights: dict, betas: tuple[float, ...] = (BOOST,)) -> str:
    return ", ".join(f"('{n}', {v}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE, {x}::DOUBLE)" for n, (v, g, b) in weights.items() for x in betas)


_ALL = _L + _rrf_sql(_cells({"all": (1.0, 1.0, 1.0)}))
ORACLE = {
    "r01_dense_topk": "WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0) SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s QUALIFY rank <= 20",
    "r03_normalised": """WITH v AS (SELECT DISTINCT chunk_id, embedding FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
        n AS (SELECT chunk_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM v)
        SELECT chunk_id, round(norm, 3) AS norm, round(CASE WHEN norm = 0 THEN 0 ELSE 1 END::DOUBLE, 6) AS norm_after FROM n""",
    "r05_lexical_tokens": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOK} AS t FROM documents WHERE text IS NOT NULL)",
    "r06_term_index": _IDX + " SELECT term, df, round(idf, 6) AS idf FROM i",
    "r07_bm25_topk": _BM + " SELECT * FROM b",
    "r08_rrf_fusion": _ALL + " SELECT query_id, chunk_id, rrf, method, rank, source_doc, hop_distance FROM t WHERE rank <= 20",
    "r09_fingerprint_dedup": _L + """, x AS (SELECT chunk_id, max(text) AS text FROM chunk_extractions GROUP BY 1), k AS (SELECT query_id, chunk_id, vector_rank, row_number() OVER (PARTITION BY query_id, substring(coalesce(text, chunk_id), 1, 80) ORDER BY vector_rank, chunk_id) AS i FROM r LEFT JOIN x USING (chunk_id) WHERE vector_rank IS NOT NULL)
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vector_rank, chunk_id) AS rank FROM k WHERE i = 1""",
    "r11_dense_only": _L + " SELECT query_id, chunk_id, round(vector_score, 6) AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY vector_rank, chunk_id) AS rank FROM r WHERE vector_rank IS NOT NULL QUALIFY rank <= 20",
    "r12_graph_only": _L + ", g AS (SELECT *, round(greatest(0, graph_score), 6) AS score FROM r WHERE graph_rank IS NOT NULL) SELECT query_id, chunk_id, score, hop_distance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM g QUALIFY rank <= 20",
    "r14_configured_fusion": _L + _rrf_sql(_cells({"x": (1.0, 0.5, 1.0)}, (1.5,))).replace("(60 + ", "(30 + ").replace("beta / 61", "beta / 31") + " SELECT query_id, chunk_id, rrf, method, rank FROM t WHERE rank <= 10",
    "r15_lane_presets": _L + _rrf_sql(_cells(PRESETS)) + " SELECT preset, query_id, chunk_id, rrf, method, rank FROM t WHERE rank <= 10",
    "f02_subquery_fusion": _L + """, u AS (SELECT query_id, chunk_id, source_doc, 'vector' AS sq, vector_score AS s FROM r UNION ALL SELECT query_id, chunk_id, source_doc, 'graph', graph_score FROM r UNION ALL SELECT query_id, chunk_id, source_doc, 'bm25', bm25_score FROM r),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, sq ORDER BY s DESC, chunk_id) - 1 AS place FROM u WHERE s IS NOT NULL AND NOT isnan(s)),
        g AS (SELECT query_id, chunk_id, sum(1 / (60 + place)) AS s, greatest(count(DISTINCT source_doc), 1) AS sources, count(DISTINCT sq) AS subs, (list(sq ORDER BY place, sq))[1] AS best_sub_query FROM p GROUP BY 1, 2)
        SELECT query_id, chunk_id, round(s * (1 + 0.1::DOUBLE * (sources - 1) + 0.05::DOUBLE * (subs - 1)), 9) AS rrf, best_sub_query FROM g""",
    "a01_ir_metrics": _JUDGE + " SELECT count(*) AS n_judged, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}, round(avg(ndcg_{k}), 6) AS ndcg_{k}" for k in (5, 10, 20)) + " FROM m",
    "m09_ranking_metrics": _JUDGE + " SELECT item_id, round(recall_10, 6) AS recall_10, round(dcg_10, 6) AS dcg_10, round(ndcg_10, 6) AS ndcg_10, round(rr, 6) AS rr FROM m",
    "a07_lane_summary": _ALL + """, u AS (SELECT query_id, chunk_id, 'vector' AS lane FROM r WHERE vector_rank IS NOT NULL UNION ALL SELECT query_id, chunk_id, 'graph' FROM r WHERE graph_rank IS NOT NULL UNION ALL SELECT query_id, chunk_id, 'bm25' FROM r WHERE bm25_rank IS NOT NULL),
        p AS (SELECT lane, u.query_id, count(*) AS n, count(t.rank) AS hits FROM u LEFT JOIN (SELECT query_id, chunk_id, rank FROM t WHERE rank <= 10) t ON t.query_id = u.query_id AND t.chunk_id = u.chunk_id GROUP BY 1, 2)
        """.rstrip() + _SF + _sf_sql("SELECT lane, query_id, source_doc FROM u JOIN r USING (query_id, chunk_id)", "lane, query_id") + """, y AS (SELECT lane, round(avg(precision), 5) AS sf_precision, round(avg(recall), 5) AS sf_recall, round(avg(f1), 5) AS sf_f1 FROM sm GROUP BY 1)
        SELECT p.lane, count(*) AS n_queries, round(avg(n), 6) AS mean_length, round(avg(hits / 10), 6) AS recall_of_fused_10, any_value(sf_precision) AS sf_precision, any_value(sf_recall) AS sf_recall, any_value(sf_f1) AS sf_f1 FROM p LEFT JOIN y USING (lane) GROUP BY 1""",
    "m04_gold_titles": _L + _SF + " SELECT * FROM gt",
    "m07_supporting_facts": _ALL + _SF + _sf_sql("SELECT query_id, source_doc FROM t WHERE rank <= 20", "query_id") + " SELECT * FROM sm",
    "r02_l2_topk": "WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(1 / (1 + list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0) SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s QUALIFY rank <= 20",
    "a09_boost_sweep": _L + _rrf_sql(_cells({"h": (1.0, 1.0, 1.0)}, (1.0, 1.1, 1.2, 1.5, 2.0))) + " SELECT beta, count(*) AS n_queries, round(avg((method = 'hybrid')::INT), 6) AS hybrid_first, round(avg(rrf), 6) AS mean_rrf FROM t WHERE rank = 1 GROUP BY 1",
    "a11_graph_rescued": _L + ", s AS (SELECT query_id, source_doc, bool_or(graph_rank IS NOT NULL) AS g, bool_or(vector_rank IS NOT NULL OR bm25_rank IS NOT NULL) AS o FROM r WHERE source_doc IS NOT NULL GROUP BY 1, 2) SELECT query_id, source_doc FROM s WHERE g AND NOT o",
    "a12_rescue_by_type": _L + """, s AS (SELECT query_id, source_doc, bool_or(graph_rank IS NOT NULL) AS g, bool_or(vector_rank IS NOT NULL OR bm25_rank IS NOT NULL) AS o FROM r WHERE source_doc IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT query_id, count(*) AS n FROM s WHERE g AND NOT o GROUP BY 1), q AS (SELECT DISTINCT query_id FROM r), ty AS (SELECT question_id AS query_id, max(question_type) AS question_type FROM agentic_ablation GROUP BY 1)
        SELECT question_type, count(*) AS n_queries, count(n) AS n_rescued, round(count(n) / count(*), 6) AS rescue_rate, coalesce(sum(n), 0)::BIGINT AS n_sources FROM q LEFT JOIN ty USING (query_id) LEFT JOIN k USING (query_id) GROUP BY 1""",
    "a50_crowd_out": _L + " SELECT query_id, source_doc, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY query_id), 6) AS share FROM r GROUP BY 1, 2",
    "a51_answer_bearing": _L + ", " + _BEAR + " SELECT query_id, chunk_id FROM ab",
    "a52_source_ranks": _L + " SELECT query_id, source_doc, min(vector_rank)::DOUBLE AS vector_rank, min(graph_rank)::DOUBLE AS graph_rank, min(bm25_rank)::DOUBLE AS bm25_rank FROM r GROUP BY 1, 2",
    "d16_lane_contrast": _L + _rrf_sql(_cells({"with": (1.0, 1.0, 1.0), "without": (1.0, 0.0, 1.0)})) + ", k AS (SELECT query_id, source_doc, bool_or(preset = 'with') AS w, bool_or(preset = 'without') AS o FROM t WHERE rank <= 10 GROUP BY 1, 2) SELECT query_id, source_doc, CASE WHEN w THEN 'gained' ELSE 'lost' END AS change FROM k WHERE w <> o",
    "s20_source_rows": "SELECT source_file, count(DISTINCT chunk_id) AS n_chunks, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM chunk_extractions GROUP BY 1",
}
