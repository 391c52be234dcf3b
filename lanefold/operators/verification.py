"""Checks of answers: claims, grounding, format, disclaimers, contradictions and credibility of evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.metrics import ABSTENTION, normalise_answer
from lanefold.functions.text import strip, strip_sql
from lanefold.operators.evaluation import _PRED, _any, _norm, failure_bucket, records
from lanefold.operators.filters import ranked
from lanefold.operators.graph import _G, _LOOKUP, _QE, e27_question_entities, entities, lookup, mention_degrees
from lanefold.operators.retrieval import _ALL
from lanefold.plans.planner import _CLS, _HOPS, plans
from lanefold.sources.shared import materialise

CLAIM_CHARS, COVERAGE, CONFLICT = 15, 0.34, 0.5
W_REF, W_ENTITY, W_PROVENANCE, REF_MAX, BASELINE, ENTITY_NORM, MAX_PHRASES = 0.4, 0.3, 0.3, 3.0, 0.5, 10.0, 10
#: Phrases of answers that decline, phrases that make a sentence no claim, question words.
DISCLAIMERS = [
    "i don't know", "i do not know", "i cannot determine", "i can't determine", "i cannot find", "i can't find", "i was unable to find", "unable to find",
    "no information", "no specific information", "not provided in the context", "not provided", "not mentioned", "not specified", "not stated", "not available",
    "is not in the context", "the context does not", "the context doesn't", "context does not contain", "context doesn't contain", "insufficient evidence",
    "insufficient information", "based on the available", "no answer can be", "cannot be determined", "however, there is no",
]
META = [
    "based on the context", "according to the", "i cannot answer", "i don't know", "not enough information", "the context does not",
    "the context doesn't", "error:", "insufficient evidence",
]
SHORT_DISCLAIMERS = ["i don't know", "i cannot", "cannot determine", "not enough information", "insufficient"]
#: Words that ground nothing; words of a fragment that is too short to be looked up alone.
GROUND_STOPS = (
    "the and for with that this from into was were are have has had his her their they she him not but you all any can did who what when where which "
    "whom whose why how"
).split()
SHORT_HALF = 4
WH = ["what", "who", "whom", "where", "when", "which", "whose", "how", "why"]
YES_NO = ["yes", "no", "yeah", "nope", "true", "false"]
NAME = r"([\p{Lu}][\p{Ll}]+(?:\s+[\p{Lu}][\p{Ll}]+)+)"
VALUE = r"\b([\p{Lu}][\p{Ll}]+) (?:was|is|has|had) (\d+(?:\.\d+)?)"


def low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def any_of(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def claims(answers: DataFrame) -> DataFrame:
    """(question_id, row_name, pos, claim): sentences over CLAIM_CHARS that are no talk about the context."""
    parts = F.filter(F.transform(F.split(F.coalesce("predicted_answer", F.lit("")), r"(?<=[.!?])\s+"), strip), lambda s: (F.length(s) > CLAIM_CHARS) & ~any_of(F.lower(s), META))
    return answers.where(~F.coalesce("predicted_answer", F.lit("")).startswith("[Error:")).select("question_id", "row_name", "gold_answer", "question", F.posexplode(parts).alias("pos", "claim"))


def v09_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(records(spark, sf_dir)).select("question_id", "row_name", "pos", "claim")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, context): the lower-cased texts of each question's ten best chunks, joined."""
    r = ranked(spark, sf_dir).where(F.col("rank") <= 10)
    return r.groupBy(F.col("query_id").alias("question_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.lower("text").alias("t")))), lambda x: x["t"]), "\n").alias("context"))


def v10_claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each answer, how many claims have all their names and numbers in the evidence, and the level."""
    c = claims(records(spark, sf_dir)).join(evidence(spark, sf_dir), "question_id", "left")
    marks = F.array_distinct(F.concat(F.regexp_extract_all("claim", F.lit(NAME), F.lit(1)), F.regexp_extract_all("claim", F.lit(r"\b(\d{2,})\b"), F.lit(1))))
    ok = F.forall(marks, lambda m: F.coalesce(F.col("context"), F.lit("")).contains(F.lower(m)))
    g = c.groupBy("question_id", "row_name").agg(F.count(F.lit(1)).alias("n_claims"), F.count(F.when(ok, 1)).alias("n_verified"))
    share = F.col("n_verified") / F.col("n_claims")
    return g.select("*", F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low").alias("level"))


def v02_entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a question's entities found in its evidence, and whether it is enough."""
    e = e27_question_entities(spark, sf_dir).withColumnRenamed("query_id", "question_id").join(evidence(spark, sf_dir), "question_id", "left")
    g = e.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.coalesce("context", F.lit("")).contains(F.lower("key")), 1)).alias("found"))
    return g.select("question_id", "n", "found", (F.round(F.col("found") / F.col("n"), 6) >= COVERAGE).alias("covered"))


def conflicts(rows: DataFrame) -> DataFrame:
    """(query_id, a, b, difference): two chunks that give one name values that differ by more than CONFLICT."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(VALUE), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(VALUE), F.lit(2)).alias("value"))
    v = rows.select("query_id", "rank", "chunk_id", F.explode(pairs).alias("x")).select("query_id", "rank", "chunk_id", "x.name", F.col("x.value").cast("double").alias("value"))
    b = v.select("query_id", "name", *[F.col(c).alias(f"{c}_b") for c in ("rank", "chunk_id", "value")])
    p = v.join(b, ["query_id", "name"]).where((F.col("rank") < F.col("rank_b")) & (F.least("value", "value_b") > 0))
    diff = F.round(F.abs(F.col("value") - F.col("value_b")) / F.greatest("value", "value_b"), 6)
    return p.withColumn("difference", diff).where(F.col("difference") > CONFLICT).groupBy("query_id", F.col("chunk_id").alias("a"), F.col("chunk_id_b").alias("b")).agg(F.max("difference").alias("difference"))


def without_conflicts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows without their query's most contradicted chunks; a query that would lose all keeps all."""
    sides = found.select("query_id", F.explode(F.array("a", "b")).alias("chunk_id")).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    worst = sides.groupBy("query_id").agg(F.max("n").alias("n"))
    marked = rows.join(sides.join(worst, ["query_id", "n"]).select("query_id", "chunk_id", F.lit(1).alias("bad")), ["query_id", "chunk_id"], "left")
    alive = marked.groupBy("query_id").agg(F.count(F.when(F.col("bad").isNull(), 1)).alias("alive"))
    return marked.join(alive, "query_id").where(F.col("bad").isNull() | (F.col("alive") == 0)).drop("bad", "alive")


def v04_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir)
    return without_conflicts(r, conflicts(r)).select("query_id", "chunk_id", "rank")


def v07_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.4 cross-references + 0.3 name density + 0.3 provenance of every chunk among its query's list."""
    names = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(1)))), 1, MAX_PHRASES)
    r = ranked(spark, sf_dir).select("query_id", "chunk_id", "method", F.lower("text").alias("low"), F.transform(names, F.lower).alias("phrases"), F.size(F.regexp_extract_all("text", F.lit(NAME), F.lit(1))).alias("n_names"))
    o = r.select("query_id", F.col("chunk_id").alias("other"), F.col("low").alias("other_low"))
    refs = r.join(o, "query_id").where((F.col("chunk_id") != F.col("other")) & (F.col("low") != F.col("other_low")) & F.exists("phrases", lambda p: F.col("other_low").contains(p))).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("refs"))
    r = r.join(refs, ["query_id", "chunk_id"], "left")
    graph = F.when(F.col("method").isin("graph", "hybrid"), 1.0).otherwise(BASELINE)
    score = W_REF * F.least(F.lit(1.0), F.coalesce("refs", F.lit(0)) / REF_MAX) + W_ENTITY * F.least(F.lit(1.0), F.col("n_names") / ENTITY_NORM) + W_PROVENANCE * graph
    return r.select("query_id", "chunk_id", F.coalesce("refs", F.lit(0)).alias("refs"), F.round(score, 6).alias("credibility"))


def final_answer(c: Column) -> Column:
    """Behind the last "final answer:" marker its first line, else the last line that is not blank."""
    tail = F.regexp_extract(c, r"(?is).*final answer:\s*[:\-—\s]*([^\n]*)", 1)
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.when(strip(tail) != "", strip(tail)).otherwise(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))


def hypothesis(question: Column, answer: Column) -> Column:
    """Question and answer as one statement."""
    a = strip(F.regexp_replace(strip(answer), r"\.+$", ""))
    q = strip(F.regexp_replace(strip(question), r"\?+$", ""))
    body, lead = strip(F.regexp_replace(q, r"^\S+\s*", "")), F.lower(F.regexp_extract(q, r"^(\S+)", 1))
    return F.when(q == "", a).when(lead.isin("who", "whom") & (body != ""), F.concat_ws(" ", a, body)).when((lead == "whose") & (body != ""), F.concat(a, F.lit("'s "), body)).otherwise(strip(F.concat_ws(" ", q, a)))


def v12_answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclaimer, yes/no answer to a wh-question, final line, hypothesis, and whether to retrieve again."""
    a = F.coalesce("predicted_answer", F.lit(""))
    disclaimer = (a == "") | a.startswith("[Error:") | any_of(F.lower(a), DISCLAIMERS)
    first = F.regexp_extract(F.lower(F.coalesce("question", F.lit(""))), r"^[\"'(¿\s]*([a-z]+)", 1)
    plain = F.regexp_replace(F.lower(strip(a)), r"[.!?,;:]+$", "")
    mismatch = first.isin(WH) & plain.isin(YES_NO)
    again = disclaimer | mismatch | (low("confidence") == "low")
    return records(spark, sf_dir).select(
        "question_id", "row_name", disclaimer.alias("disclaimer"), mismatch.alias("format_mismatch"), final_answer(a).alias("final_answer"),
        hypothesis(F.coalesce("question", F.lit("")), a).alias("hypothesis"), F.coalesce(again, F.lit(False)).alias("retrieve_again"),
    )


def v21_first_chunk_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without generation the answer is the first chunk's text."""
    return ranked(spark, sf_dir).where("rank = 1").select("query_id", F.col("text").alias("answer"))


def f19_expanded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question, draft answer and up to three entities as the second retrieval's query."""
    e = e27_question_entities(spark, sf_dir).groupBy(F.col("query_id").alias("question_id")).agg(F.slice(F.array_sort(F.collect_set("key")), 1, 3).alias("e"))
    r = records(spark, sf_dir).join(e, "question_id", "left")
    return r.select("question_id", "row_name", F.concat_ws(" ", "question", "predicted_answer", F.array_join("e", " ")).alias("expanded"))


def a18_verifier_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of wrong answers of questions with evidence, gold present meaning that the evidence holds it."""
    r = records(spark, sf_dir).where(~F.col("exact_match")).join(evidence(spark, sf_dir), "question_id")
    gold = normalise_answer(F.col("gold_answer"))
    held = (gold != "") & normalise_answer(F.col("context")).contains(gold)
    bucket = F.when(held, failure_bucket(F.lit(True))).otherwise("a_retrieval_miss")
    return r.groupBy("row_name", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def w33_retrieval_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's cache entry written as JSON and read again: plan pattern, gold answer, and the chunks in order
    with text, score, hop and whether the graph found them. The score is scaled and rounded as SQL does it: F.round with digits
    goes by the shortest decimal form, and so takes 0.0651745, a double just below the tie, upwards."""
    r = ranked(spark, sf_dir)
    item = F.struct("text", (F.round(F.col("rrf") * 1e6) / 1e6).alias("score"), F.col("hop_distance").alias("hop_index"), F.col("method").isin("graph", "hybrid").alias("is_graph_based"))
    g = r.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("x")))), lambda y: y["x"]).alias("chunks"))
    gold = records(spark, sf_dir).groupBy(F.col("question_id").alias("query_id")).agg(F.max("gold_answer").alias("gold"))
    entry = g.join(plans(spark, sf_dir).select("query_id", "pattern"), "query_id", "left").join(gold, "query_id", "left")
    entry = entry.select("query_id", F.to_json(F.struct("pattern", "gold", "chunks")).alias("entry"))
    back = entry.select("query_id", F.from_json("entry", "pattern string, gold string, chunks array<struct<text:string,score:double,hop_index:int,is_graph_based:boolean>>").alias("e"))
    return back.select("query_id", "e.pattern", "e.gold", F.posexplode("e.chunks").alias("pos", "c")).select("query_id", "pattern", "gold", "pos", "c.text", "c.score", "c.hop_index", "c.is_graph_based")


def graph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V02 with a graph: (query_id, n_entities, n_found): a question's entities, and those that lead to a mentioned node."""
    keys = e27_question_entities(spark, sf_dir)
    names = entities(spark, sf_dir).where(F.col("name").isNotNull()).select("entity_id", "name")
    alive = mention_degrees(spark, sf_dir).select("entity_id").join(names, "entity_id").select("name").distinct()
    found = lookup(keys.select("key").distinct(), names.select("name").distinct()).join(alive, "name", "left_semi").select("key", F.lit(1).alias("hit")).distinct()
    return keys.join(found, "key", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_entities"), F.count("hit").alias("n_found"))


def v01_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's evidence before generation: chunks, entity coverage in the graph, chunks lost to contradictions, and
    the status: insufficient_evidence, contradiction_detected (which holds over it), or passed."""
    r = materialise(ranked(spark, sf_dir), "ranked")
    left = without_conflicts(r, conflicts(r)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_left"))
    q = records(spark, sf_dir).select(F.col("question_id").alias("query_id")).distinct()
    v = q.join(r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks")), "query_id", "left").join(left, "query_id", "left").join(graph_coverage(spark, sf_dir), "query_id", "left")
    n, e = F.coalesce("n_chunks", F.lit(0)), F.coalesce("n_entities", F.lit(0))
    lost = n - F.coalesce("n_left", F.lit(0))
    covered = (e == 0) | (F.round(F.col("n_found") / F.col("n_entities"), 6) >= COVERAGE)
    status = F.when(n == 0, "insufficient_evidence").when(lost > 0, "contradiction_detected").when(~covered, "insufficient_evidence").otherwise("passed")
    return v.select("query_id", n.alias("n_chunks"), e.alias("n_entities"), F.coalesce("n_found", F.lit(0)).alias("n_found"), lost.alias("n_lost"), status.alias("status"))


def f18_reretrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why an answer calls for a second retrieval, the first reason that holds, or ok.

    empty_answer, verifier_error, low_confidence, disclaimer, or ungrounded: no content word of the answer stands in the
    evidence (no evidence grounds nothing, but is no reason either).
    """
    a = F.lower(strip(F.coalesce("predicted_answer", F.lit(""))))
    level = F.lower(strip(F.coalesce("confidence", F.lit(""))))
    r = records(spark, sf_dir).join(evidence(spark, sf_dir), "question_id", "left")
    tokens = F.filter(F.regexp_extract_all(a, F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1)), lambda t: ~t.isin(GROUND_STOPS))
    loose = (F.coalesce("context", F.lit("")) != "") & (F.size(tokens) > 0) & ~F.exists(tokens, lambda t: F.col("context").contains(t))
    reason = F.when(a == "", "empty_answer").when(level == "error", "verifier_error").when(level == "low", "low_confidence").when(any_of(a, SHORT_DISCLAIMERS), "disclaimer").when(loose, "ungrounded").otherwise("ok")
    return r.select("question_id", "row_name", reason.alias("reason"))


def f20_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the full row's answer replaces the verifier row's: it is there and no error, and the old one is empty, an
    error or a disclaimer, or the new one stands in the evidence while the old one does not."""
    side = lambda row, name: records(spark, sf_dir).where(F.col("row_name") == row).select("question_id", F.coalesce("predicted_answer", F.lit("")).alias(name))
    r = side("row4_verifier", "old").join(side("row5_full", "new"), "question_id").join(evidence(spark, sf_dir), "question_id", "left")
    old, new, context = F.lower(strip(F.col("old"))), F.lower(strip(F.col("new"))), F.coalesce("context", F.lit(""))
    poor = (old == "") | F.col("old").startswith("[Error:") | any_of(old, ["don't know", "cannot determine", "insufficient"])
    better = (F.col("new") != "") & ~F.col("new").startswith("[Error:") & (poor | (context.contains(new) & ~context.contains(old)))
    return r.select("question_id", better.alias("accepted"))


def f17_gated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plans that only look decomposed pass through as one hop: the generic fallback, and connector splits whose every
    sub-query has at most SHORT_HALF words."""
    p = plans(spark, sf_dir)
    words = lambda h: F.size(F.filter(F.split(h["sub_query"], r"\s+"), lambda w: w != ""))
    short = F.forall("hops", lambda h: words(h) <= SHORT_HALF)
    gated = (F.col("pattern") == "fallback_generic_2hop") | ((F.col("pattern") == "connector_split") & short)
    return p.select("query_id", "pattern", gated.alias("gated"), F.when(gated, F.lit(1)).otherwise(F.size("hops")).alias("n_hops"), F.when(gated, F.col("question")).otherwise(F.element_at("hops", 1)["sub_query"]).alias("first_query"))


def v15_bridge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's hops as numbered steps for the prompt, the last one to derive the answer."""
    step = lambda h, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), h["sub_query"], F.when(i == F.size("hops") - 1, " → derive the final answer").otherwise(" → identify the intermediate result"))
    return plans(spark, sf_dir).select("query_id", F.array_join(F.transform("hops", step), "\n").alias("chain"))


QUERIES = {f.__name__: f for f in (v01_validation, f17_gated_plan, f18_reretrieval, f20_keep_best, v15_bridge_chain, a18_verifier_taxonomy, w33_retrieval_cache, v02_entity_coverage, v04_conflicts, v07_credibility, v09_claims, v10_claim_support, v12_answer_checks, v21_first_chunk_answer, f19_expanded_query)}


def _in(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


_A = _ALL + """, kx AS (SELECT query_id, chunk_id, rrf, method, rank FROM t WHERE rank <= 20), xt AS (SELECT chunk_id, max(text) AS text FROM chunk_extractions GROUP BY 1), kt AS (SELECT kx.*, coalesce(text, '') AS text FROM kx LEFT JOIN xt USING (chunk_id)),
    ev AS (SELECT query_id AS question_id, string_agg(lower(text), chr(10) ORDER BY rank) AS context FROM kt WHERE rank <= 10 GROUP BY 1), rc AS (SELECT DISTINCT * EXCLUDE (finished_at) FROM agentic_ablation)"""
_CLAIM = rf""", sp AS (SELECT question_id, row_name, string_split(regexp_replace(coalesce(predicted_answer, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM rc WHERE NOT starts_with(coalesce(predicted_answer, ''), '[Error:')),
    fl AS (SELECT question_id, row_name, list_filter(list_transform(s, lambda x: {strip_sql('x')}), lambda x: length(x) > 15 AND NOT {_in('lower(x)', META)}) AS c FROM sp), ca AS (SELECT question_id, row_name, unnest(c) AS claim, (generate_subscripts(c, 1) - 1)::INT AS pos FROM fl)"""
_HELD = f"{_norm('gold_answer')} <> '' AND contains({_norm('context')}, {_norm('gold_answer')})"
ORACLE = {
    "a18_verifier_taxonomy": _A + f""" SELECT row_name, CASE WHEN NOT ({_HELD}) THEN 'a_retrieval_miss' WHEN {_PRED} = '' OR {_any(_PRED, ABSTENTION)} THEN 'd_abstention' WHEN coalesce(f1_score, 0) >= 0.5 THEN 'e_close_miss'
        WHEN ({_norm('gold_answer')} IN ('yes', 'no')) <> ({_norm('predicted_answer')} IN ('yes', 'no')) THEN 'c_format_mismatch' ELSE 'b_grounded_halluc' END AS bucket, count(*) AS n FROM rc JOIN ev USING (question_id) WHERE NOT exact_match GROUP BY 1, 2""",
    "v09_claims": _A + _CLAIM + " SELECT question_id, row_name, pos, claim FROM ca",
    "v10_claim_support": _A + _CLAIM + rf""", mk AS (SELECT question_id, row_name, list_distinct(list_concat(regexp_extract_all(claim, '{NAME}', 1), regexp_extract_all(claim, '\b(\d{{2,}})\b', 1))) AS m FROM ca),
        g AS (SELECT mk.question_id, row_name, count(*) AS n_claims, count(*) FILTER (len(list_filter(m, lambda x: NOT contains(coalesce(context, ''), lower(x)))) = 0) AS n_verified FROM mk LEFT JOIN ev USING (question_id) GROUP BY 1, 2)
        SELECT *, CASE WHEN n_verified / n_claims >= 0.8 THEN 'high' WHEN n_verified / n_claims >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM g""",
    "v02_entity_coverage": _A + ", " + _QE + ", g AS (SELECT qk.query_id AS question_id, count(*) AS n, count(*) FILTER (contains(coalesce(context, ''), lower(key))) AS found FROM qk LEFT JOIN ev ON ev.question_id = qk.query_id GROUP BY 1) SELECT *, round(found / n, 6) >= 0.34 AS covered FROM g",
    "v07_credibility": _A + f""", nm AS (SELECT query_id, chunk_id, method, lower(text) AS low, list_transform(list_sort(list_distinct(regexp_extract_all(text, '{NAME}', 1)))[:10], lambda x: lower(x)) AS p, len(regexp_extract_all(text, '{NAME}', 1)) AS n FROM kt),
        rf AS (SELECT a.query_id, a.chunk_id, count(*) AS refs FROM nm a JOIN nm b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id AND a.low <> b.low AND len(list_filter(a.p, lambda x: contains(b.low, x))) > 0 GROUP BY 1, 2)
        SELECT query_id, chunk_id, coalesce(refs, 0) AS refs, round(0.4::DOUBLE * least(1, coalesce(refs, 0) / 3) + 0.3::DOUBLE * least(1, n / 10) + 0.3::DOUBLE * CASE WHEN method IN ('graph', 'hybrid') THEN 1 ELSE 0.5 END, 6) AS credibility FROM nm LEFT JOIN rf USING (query_id, chunk_id)""",
    "v21_first_chunk_answer": _A + " SELECT query_id, text AS answer FROM kt WHERE rank = 1",
    "f19_expanded_query": _A + ", " + _QE + ", ge AS (SELECT query_id AS question_id, array_to_string(list_sort(list(DISTINCT key))[:3], ' ') AS e FROM qk GROUP BY 1) SELECT question_id, row_name, concat_ws(' ', question, predicted_answer, e) AS expanded FROM rc LEFT JOIN ge USING (question_id)",
}
_RAW = "coalesce(predicted_answer, '')"
_PLAIN = f"regexp_replace(lower({strip_sql(_RAW)}), '[.!?,;:]+$', '')"
_TAIL = strip_sql(f"regexp_extract({_RAW}, '(?is).*final answer:\\s*[:\\-—\\s]*([^\\n]*)', 1)")
_LINES = f"list_filter(list_transform(string_split({_RAW}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"
_HYP_A = strip_sql(f"regexp_replace({strip_sql(_RAW)}, '\\.+$', '')")
_HYP_Q = strip_sql(f"regexp_replace({strip_sql(chr(99) + 'oalesce(question, ' + chr(39) * 2 + ')')}, '\\?+$', '')")
_LOW = "lower(§predicted_answer§)"
_CONF = f""", vx AS (SELECT query_id, rank, chunk_id, unnest(regexp_extract_all(text, '{VALUE}', 1)) AS name, unnest(regexp_extract_all(text, '{VALUE}', 2))::DOUBLE AS v FROM kt),
        cq AS (SELECT DISTINCT a.query_id, a.chunk_id AS a, b.chunk_id AS b FROM vx a JOIN vx b ON a.query_id = b.query_id AND a.name = b.name AND a.rank < b.rank WHERE least(a.v, b.v) > 0 AND round(abs(a.v - b.v) / greatest(a.v, b.v), 6) > 0.5),
        sd AS (SELECT query_id, chunk_id, count(*) AS n FROM (SELECT query_id, a AS chunk_id FROM cq UNION ALL SELECT query_id, b FROM cq) GROUP BY 1, 2), bd AS (SELECT query_id, chunk_id FROM sd QUALIFY n = max(n) OVER (PARTITION BY query_id)),
        """
ORACLE |= {
    "v12_answer_checks": _A + f""", z AS (SELECT question_id, row_name, confidence, {_RAW} = '' OR starts_with({_RAW}, '[Error:') OR {_in(f'lower({_RAW})', DISCLAIMERS)} AS disclaimer,
            regexp_extract(lower(coalesce(question, '')), '^["''(¿\\s]*([a-z]+)', 1) IN ({', '.join(f"'{x}'" for x in WH)}) AND {_PLAIN} IN ({', '.join(f"'{x}'" for x in YES_NO)}) AS format_mismatch,
            CASE WHEN {_TAIL} <> '' THEN {_TAIL} ELSE coalesce({_LINES}[-1], '') END AS final_answer, {_HYP_A} AS ha, {_HYP_Q} AS hq FROM rc),
        y AS (SELECT *, {strip_sql("regexp_replace(hq, '^[^ ]+\\s*', '')")} AS body, lower(regexp_extract(hq, '^([^\\s]+)', 1)) AS lead FROM z)
        SELECT question_id, row_name, disclaimer, format_mismatch, final_answer, CASE WHEN hq = '' THEN ha WHEN lead IN ('who', 'whom') AND body <> '' THEN ha || ' ' || body WHEN lead = 'whose' AND body <> '' THEN ha || chr(39) || 's ' || body ELSE {strip_sql("hq || ' ' || ha")} END AS hypothesis,
            disclaimer OR format_mismatch OR coalesce(lower(confidence) = 'low', FALSE) AS retrieve_again FROM y""",
    "v04_conflicts": _A + _CONF + """mk AS (SELECT kt.query_id, kt.chunk_id, kt.rank, bd.chunk_id IS NOT NULL AS bad FROM kt LEFT JOIN bd USING (query_id, chunk_id)) SELECT query_id, chunk_id, rank FROM mk QUALIFY NOT bad OR bool_and(bad) OVER (PARTITION BY query_id)""",
    "v01_validation": _G + ", " + _QE + _LOOKUP + ", " + _A.removeprefix("WITH ") + _CONF + """mk AS (SELECT kt.query_id, kt.rank, bd.chunk_id IS NOT NULL AS bad FROM kt LEFT JOIN bd USING (query_id, chunk_id)),
        lf AS (SELECT query_id, count(*) AS n_chunks, CASE WHEN bool_and(bad) THEN 0 ELSE count(*) FILTER (bad) END AS n_lost FROM mk GROUP BY 1), hk AS (SELECT DISTINCT key FROM lo JOIN en USING (name) JOIN me USING (entity_id)),
        gc AS (SELECT qk.query_id, count(*) AS n_entities, count(hk.key) AS n_found FROM qk LEFT JOIN hk USING (key) GROUP BY 1), vq AS (SELECT DISTINCT question_id AS query_id FROM rc),
        vv AS (SELECT query_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_entities, 0) AS n_entities, coalesce(n_found, 0) AS n_found, coalesce(n_lost, 0) AS n_lost FROM vq LEFT JOIN lf USING (query_id) LEFT JOIN gc USING (query_id))
        SELECT *, CASE WHEN n_chunks = 0 THEN 'insufficient_evidence' WHEN n_lost > 0 THEN 'contradiction_detected' WHEN n_entities > 0 AND round(n_found / n_entities, 6) < 0.34 THEN 'insufficient_evidence' ELSE 'passed' END AS status FROM vv""",
    "f18_reretrieval": _A + f""", z AS (SELECT rc.question_id, row_name, {_LOW} AS a, lower(§confidence§) AS lv, coalesce(context, '') AS context FROM rc LEFT JOIN ev USING (question_id)), y AS (SELECT *, list_filter(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda t: t NOT IN ({', '.join(f"'{x}'" for x in GROUND_STOPS)})) AS tk FROM z)
        SELECT question_id, row_name, CASE WHEN a = '' THEN 'empty_answer' WHEN lv = 'error' THEN 'verifier_error' WHEN lv = 'low' THEN 'low_confidence' WHEN {_in('a', SHORT_DISCLAIMERS)} THEN 'disclaimer' WHEN context <> '' AND len(tk) > 0 AND len(list_filter(tk, lambda t: contains(context, t))) = 0 THEN 'ungrounded' ELSE 'ok' END AS reason FROM y""",
    "f20_keep_best": _A + f""", z AS (SELECT o.question_id, coalesce(o.predicted_answer, '') AS old, coalesce(n.predicted_answer, '') AS new, coalesce(context, '') AS context FROM rc o JOIN rc n ON n.question_id = o.question_id AND n.row_name = 'row5_full' LEFT JOIN ev ON ev.question_id = o.question_id WHERE o.row_name = 'row4_verifier'),
        y AS (SELECT *, lower({strip_sql('old')}) AS ol, lower({strip_sql('new')}) AS nl FROM z)
        SELECT question_id, new <> '' AND NOT starts_with(new, '[Error:') AND (ol = '' OR starts_with(old, '[Error:') OR {_in('ol', ["don't know", "cannot determine", "insufficient"])} OR (contains(context, nl) AND NOT contains(context, ol))) AS accepted FROM y""",
    "w33_retrieval_cache": _CLS + _HOPS + ", " + _A.removeprefix("WITH ") + """, gd AS (SELECT question_id AS query_id, max(gold_answer) AS gold FROM rc GROUP BY 1)
        SELECT t.query_id, pattern, gold, (t.rank - 1)::INT AS pos, coalesce(xt.text, '') AS text, round(t.rrf, 6) AS score, t.hop_distance AS hop_index, t.method IN ('graph', 'hybrid') AS is_graph_based FROM t LEFT JOIN xt USING (chunk_id) LEFT JOIN pe ON pe.query_id = t.query_id LEFT JOIN gd ON gd.query_id = t.query_id WHERE t.rank <= 20""",
    "f17_gated_plan": _CLS + _HOPS + f""", z AS (SELECT *, pattern = 'fallback_generic_2hop' OR (pattern = 'connector_split' AND len(list_filter(hops, lambda h: len(list_filter(regexp_split_to_array(h.sub_query, '\\s+'), lambda w: w <> '')) > {SHORT_HALF})) = 0) AS gated FROM pe)
        SELECT query_id, pattern, gated, CASE WHEN gated THEN 1 ELSE len(hops) END AS n_hops, CASE WHEN gated THEN question ELSE hops[1].sub_query END AS first_query FROM z""",
    "v15_bridge_chain": _CLS + _HOPS + " SELECT query_id, array_to_string(list_transform(hops, lambda h, i: 'Step ' || i || ': ' || h.sub_query || CASE WHEN i = len(hops) THEN ' → derive the final answer' ELSE ' → identify the intermediate result' END), chr(10)) AS chain FROM pe",
}
for _n in ("f18_reretrieval",):
    ORACLE[_n] = re.sub("§([^§]+)§", lambda m: strip_sql(f"coalesce({m[1]}, '')"), ORACLE[_n])
ORACLE["a18_verifier_taxonomy"] = re.sub("§([^§]+)§", lambda m: strip_sql(f"coalesce({m[1]}, '')"), ORACLE["a18_verifier_taxonomy"])
