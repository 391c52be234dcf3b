"""Aggregates, failure taxonomies and calibration over evaluation records (one per question and configuration)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.functions.metrics import (
    ABSTENTION,
    ABSTENTION_SHORT,
    SOFT_F1,
    YESNO_ANSWERS,
    confidence_level,
    contains_any,
    exact_match,
    normalise_answer,
    token_f1,
)
from lanefold.functions.text import strip, strip_sql
from lanefold.operators.skew import numbered, prefix_sums
from lanefold.sources.shared import load

BUDGET_MS = 60_000.0
ROWS = ["row1_llm_only", "row2_navigator", "row3_planner", "row4_verifier", "row5_full"]
#: The probability each confidence level stands for, and the levels' order.
PROXY = {"high": 0.9, "medium": 0.7, "low": 0.3}
RANK = {"high": 3, "medium": 2, "low": 1, "error": 0}
#: Cloud price per million prompt and generated tokens, tokens of a query, added latency.
PRICE_IN, PRICE_OUT, PROMPT_TOKENS, GEN_TOKENS, CLOUD_MS = 2.5, 10.0, 1200, 40, 1500.0
COST = PROMPT_TOKENS / 1e6 * PRICE_IN + GEN_TOKENS / 1e6 * PRICE_OUT
FRACTIONS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0]
TARGETS = [0.5, 0.6, 0.7, 0.8, 0.85, 0.95]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records, one per (question_id, row_name): the one finished last.

    Of records finished at the same time each column's greatest value holds. Only the columns that a query uses are read
    and moved, as unused aggregates are pruned.
    """
    r = load(spark, sf_dir, "agentic_ablation")
    keys = ["question_id", "row_name"]
    last = lambda c: F.max(F.struct(F.col("finished_at"), F.col(c)))[c].alias(c)
    return r.groupBy(*keys).agg(*[last(c) for c in r.columns if c not in (*keys, "finished_at")])


def retrieved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, titles): the distinct sources of each question's retrieval results, in byte order."""
    r = load(spark, sf_dir, "retrieval_results").where(F.col("query_id").isNotNull() & F.col("source_doc").isNotNull())
    return r.groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_set("source_doc")).alias("titles"))


def rate(c: Column, digits: int = 6) -> Column:
    """Share of rows for which c holds; a null counts as not."""
    return F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), digits)


def mean(c: str) -> Column:
    return F.round(F.avg(F.coalesce(F.col(c), F.lit(0.0))), 8)


def share_of(hit: Column, base: Column) -> Column:
    """Hits among the base rows, 0 without any."""
    n = F.count(F.when(base, 1))
    return F.round(F.when(n > 0, F.count(F.when(base & hit, 1)) / n).otherwise(F.lit(0.0)), 6)


def gold_() -> Column:
    return F.col("all_gold_retrieved")


def em_() -> Column:
    return F.col("exact_match")


def soft_() -> Column:
    return F.col("answer_correct")


def err_() -> Column:
    return F.col("llm_error")


def level_() -> Column:
    return confidence_level(F.col("confidence"))


def right_() -> Column:
    """Correct in the soft sense."""
    return F.coalesce(F.col("f1_score"), F.lit(0.0)) >= SOFT_F1


def outcome_columns() -> list[Column]:
    """The rates of a configuration: accuracy, retrieval, delivery and the four-way split of outcomes."""
    return [
        F.count(F.lit(1)).alias("n"), rate(em_()).alias("em"), rate(soft_()).alias("soft_em"), mean("f1_score").alias("f1"),
        mean("time_ms").alias("avg_time_ms"), rate(F.col("retrieval_count") > 0).alias("coverage"), rate(gold_()).alias("sf_recall"),
        share_of(soft_(), gold_()).alias("retrieval_only_em"), share_of(em_(), gold_()).alias("em_given_retrieval_ok"), rate(err_()).alias("llm_error_rate"),
        rate(~gold_()).alias("pipeline_failed_rate"), rate(gold_() & err_()).alias("ok_llm_failed_rate"), rate(gold_() & ~err_() & ~soft_()).alias("ok_llm_wrong_rate"), rate(gold_() & soft_()).alias("ok_llm_ok_rate"),
    ]


_OUT = """count(*) AS n, round(avg(CASE WHEN exact_match THEN 1.0::DOUBLE ELSE 0 END), 6) AS em,
    round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0 END), 6) AS soft_em, round(avg(coalesce(f1_score, 0)), 8) AS f1,
    round(avg(coalesce(time_ms, 0)), 8) AS avg_time_ms, round(avg(CASE WHEN retrieval_count > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
    round(avg(CASE WHEN all_gold_retrieved THEN 1.0::DOUBLE ELSE 0 END), 6) AS sf_recall,
    round(coalesce(count(*) FILTER (all_gold_retrieved AND answer_correct) / nullif(count(*) FILTER (all_gold_retrieved), 0), 0), 6) AS retrieval_only_em,
    round(coalesce(count(*) FILTER (all_gold_retrieved AND exact_match) / nullif(count(*) FILTER (all_gold_retrieved), 0), 0), 6) AS em_given_retrieval_ok,
    round(avg(CASE WHEN llm_error THEN 1.0::DOUBLE ELSE 0 END), 6) AS llm_error_rate,
    round(avg(CASE WHEN NOT all_gold_retrieved THEN 1.0::DOUBLE ELSE 0 END), 6) AS pipeline_failed_rate,
    round(avg(CASE WHEN all_gold_retrieved AND llm_error THEN 1.0::DOUBLE ELSE 0 END), 6) AS ok_llm_failed_rate,
    round(avg(CASE WHEN all_gold_retrieved AND NOT llm_error AND NOT answer_correct THEN 1.0::DOUBLE ELSE 0 END), 6) AS ok_llm_wrong_rate,
    round(avg(CASE WHEN all_gold_retrieved AND answer_correct THEN 1.0::DOUBLE ELSE 0 END), 6) AS ok_llm_ok_rate"""
_REC = "WITH r AS (SELECT DISTINCT * EXCLUDE (finished_at) FROM agentic_ablation)"


def a02_config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02 and A03 in one pass: per dataset and configuration, and by question type within (type null: all)."""
    r = records(spark, sf_dir)
    sets = r.groupingSets([["dataset", "row_name"], ["dataset", "row_name", "question_type"]], "dataset", "row_name", "question_type")
    return sets.agg(F.grouping("question_type").cast("int").alias("all_types"), *outcome_columns())


def a04_marginal_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 gained per extra second against the first configuration of the dataset; null where not measurable."""
    per = records(spark, sf_dir).groupBy("dataset", "row_name").agg(F.avg("f1_score").alias("f1"), F.avg(F.coalesce("time_ms", F.lit(0.0))).alias("ms"))
    w = Window.partitionBy("dataset").orderBy("row_name")
    df, ds = F.col("f1") - F.first("f1").over(w), (F.col("ms") - F.first("ms").over(w)) / 1000
    mur = F.when((F.row_number().over(w) == 1) | (F.abs(ds) < 0.001), None).when(ds > 0, df / ds).when(df > 0, F.lit(float("inf"))).otherwise(df / ds)
    return per.select("dataset", "row_name", (F.round(mur, 6) + 0.0).alias("mur"))


def by_key(key: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).groupBy(key).agg(*outcome_columns())

    return query


def failure_bucket(present: Column | None = None) -> Column:
    """The bucket of a wrong answer; ``present`` tells whether the gold reached the model.

    Without it, the strict signal counts where it is known, else whether the titles of the retrieved sources (column
    ``titles``) hold the gold answer.
    """
    gold = normalise_answer(F.col("gold_answer"))
    held = (gold != "") & normalise_answer(F.array_join("titles", " ")).contains(gold) if present is None else None
    present = F.coalesce(gold_(), held, F.lit(False)) if present is None else present
    pred = F.lower(strip(F.coalesce("predicted_answer", F.lit(""))))
    yes_no = lambda c: normalise_answer(F.col(c)).isin("yes", "no")
    return (
        F.when(~present, "a_retrieval_miss")
        .when((pred == "") | contains_any(pred, ABSTENTION), "d_abstention")
        .when(F.coalesce("f1_score", F.lit(0.0)) >= 0.5, "e_close_miss")
        .when(yes_no("gold_answer") != yes_no("predicted_answer"), "c_format_mismatch")
        .otherwise("b_grounded_halluc")
    )


#: RE2 knows word boundaries in ASCII only, so articles are matched with their neighbours, twice for articles in a row.
_ART = r"(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{N}}_]|$)"
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(§{c}§), '""" + _ART + r"""', '\1 \2', 'g'), '""" + _ART + r"""', '\1 \2', 'g'), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+', ' ', 'g'))"""


def _norm(c: str) -> str:
    return _NORM.format(c=c)


def _any(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


_PRED = "lower(§predicted_answer§)"
_TITLES = _REC + ", ti AS (SELECT query_id AS question_id, list_sort(list_distinct(list(source_doc))) AS titles FROM retrieval_results WHERE query_id IS NOT NULL AND source_doc IS NOT NULL GROUP BY 1), wr AS (SELECT r.*, titles FROM r LEFT JOIN ti USING (question_id) WHERE NOT coalesce(exact_match, FALSE))"
_BUCKET = f"""CASE WHEN NOT coalesce(all_gold_retrieved, {_norm('gold_answer')} <> '' AND contains({_norm("array_to_string(titles, ' ')")}, {_norm('gold_answer')}), FALSE) THEN 'a_retrieval_miss'
    WHEN {_PRED} = '' OR {_any(_PRED, ABSTENTION)} THEN 'd_abstention' WHEN coalesce(f1_score, 0) >= 0.5 THEN 'e_close_miss'
    WHEN ({_norm('gold_answer')} IN ('yes', 'no')) <> ({_norm('predicted_answer')} IN ('yes', 'no')) THEN 'c_format_mismatch' ELSE 'b_grounded_halluc' END"""


def wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records without an exact match, with the titles of their question's retrieved sources."""
    r = records(spark, sf_dir).where(~F.coalesce(em_(), F.lit(False)))
    return r.join(retrieved_sources(spark, sf_dir), "question_id", "left")


def a13_failure_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong(spark, sf_dir).select("question_id", "row_name", failure_bucket().alias("bucket"))


def a16_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong(spark, sf_dir).groupBy("row_name", failure_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def a17_bucket_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = wrong(spark, sf_dir).groupBy(failure_bucket().alias("bucket")).pivot("row_name", ROWS).count()
    return counts.select("bucket", *[F.coalesce(F.col(r), F.lit(0)).cast("long").alias(r) for r in ROWS])


def a15_halluc_subbucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a grounded hallucination stands in the title of a retrieved source (a wrong entity) or is free."""
    r = wrong(spark, sf_dir).where(failure_bucket() == "b_grounded_halluc")
    p = normalise_answer(F.col("predicted_answer"))
    titled = (p != "") & F.coalesce(F.exists("titles", lambda t: normalise_answer(t).contains(p)), F.lit(False))
    return r.groupBy("row_name", F.when(titled, "b1_wrong_entity_in_titles").otherwise("b2_freegen_or_other").alias("sub_bucket")).agg(F.count(F.lit(1)).alias("n"))


def a19_failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure class of every wrong answer, with the navigator row of the same question as baseline."""
    r = records(spark, sf_dir)
    base = r.where(F.col("row_name") == ROWS[1]).select("question_id", em_().alias("base_em"))
    pred, gold = F.lower(strip(F.coalesce("predicted_answer", F.lit("")))), F.lower(strip(F.coalesce("gold_answer", F.lit(""))))
    cls = (
        F.when(err_(), "llm_error").when(~F.coalesce(gold_(), F.lit(False)), "retrieval_miss")
        .when(pred.isin(YESNO_ANSWERS) & ~gold.isin("yes", "no"), "format_yn")
        .when(contains_any(pred, ABSTENTION_SHORT), "format_abstention")
        .when((pred != "") & F.lower("question").contains(pred) & (pred != gold), "bridge_confusion")
        .when(F.col("base_em"), "context_dilution").otherwise("unclassified")
    )
    return r.where(~em_()).join(base, "question_id", "left").groupBy("row_name", cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def pairs_of_rows(r: DataFrame) -> DataFrame:
    """Each question under two adjacent rows: row_a, row_b and both records' answer, match and f1."""
    side = lambda s, rows: r.where(F.col("row_name").isin(rows)).select("question_id", F.col("row_name").alias(f"row_{s}"), em_().alias(f"em_{s}"), F.col("f1_score").alias(f"f1_{s}"), F.col("predicted_answer").alias(f"answer_{s}"))
    follows = F.create_map(*[F.lit(x) for ab in zip(ROWS, ROWS[1:]) for x in ab])
    a, b = side("a", ROWS[:-1]).withColumn("row_b", follows[F.col("row_a")]), side("b", ROWS[1:])
    return a.join(b, ["question_id", "row_b"])


def a20_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("em_a"), F.col("em_b")
    kind = F.when(a & b, "stayed_correct").when(~a & ~b, "stayed_wrong").when(~a & b, "gained").otherwise("lost")
    return pairs_of_rows(records(spark, sf_dir)).groupBy("row_a", "row_b", kind.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def a23_answer_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_of_rows(records(spark, sf_dir))
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    p = p.where(low("answer_a") != low("answer_b"))
    a, b = F.col("em_a"), F.col("em_b")
    return p.groupBy("row_a", "row_b").agg(
        F.count(F.lit(1)).alias("answer_changed"), F.count(F.when(~a & b, 1)).alias("fixed"), F.count(F.when(a & ~b, 1)).alias("broke"), F.count(F.when(a == b, 1)).alias("churn")
    )


_PAIR = _REC + """, o(row_a, row_b) AS (VALUES ('row1_llm_only', 'row2_navigator'), ('row2_navigator', 'row3_planner'), ('row3_planner', 'row4_verifier'), ('row4_verifier', 'row5_full')),
    p AS (SELECT o.row_a, o.row_b, a.exact_match AS em_a, b.exact_match AS em_b, lower(§a.predicted_answer§) AS pa, lower(§b.predicted_answer§) AS pb
        FROM o JOIN r a ON a.row_name = o.row_a JOIN r b ON b.row_name = o.row_b AND a.question_id = b.question_id)"""


def a21_row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("row_name").agg(
        F.count(F.lit(1)).alias("n"), rate(em_()).alias("em"), rate(gold_()).alias("sf_recall"), share_of(em_(), gold_()).alias("em_given_retr_ok"),
        mean("retrieval_count").alias("avg_retrieval_count"), F.max("retrieval_count").alias("max_retrieval_count"),
        mean("verifier_iterations").alias("avg_verifier_iters"), F.max("verifier_iterations").alias("max_verifier_iters"),
    )


def a22_planner_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of routed query type, hop count and entity count, in one pass."""
    r = records(spark, sf_dir).select("row_name", F.coalesce("planner_query_type", F.lit("unknown")).alias("t"), F.coalesce(F.col("hop_count").cast("string"), F.lit("0")).alias("h"), F.coalesce(F.col("n_entities").cast("string"), F.lit("0")).alias("e"))
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in (("query_type", "t"), ("hop_count", "h"), ("n_entities", "e"))]))
    return r.select("row_name", sides.alias("x")).groupBy("row_name", "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row_name the n of timed records and the wanted places, found by distributed numbering."""
    r = records(spark, sf_dir).where(F.col("time_ms").isNotNull() & ~F.isnan("time_ms")).select("row_name", "question_id", "time_ms")
    return numbered(r, ["row_name"], {"_o": F.col("time_ms"), "_q": F.col("question_id")})


def a24_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 per row: mean, median, element pick at floor(0.95 (n - 1)) and maximum, without gathering the times."""
    t = timed(spark, sf_dir)
    n, p = F.col("_n"), F.col("_place")
    at = lambda k: F.max(F.when(p == k, F.col("time_ms")))
    return t.groupBy("row_name").agg(
        F.count(F.lit(1)).alias("n_timed"), F.round(F.avg("time_ms"), 6).alias("mean_ms"),
        F.round((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2, 6).alias("median_ms"),
        F.round(at(F.floor(0.95 * (n - 1)) + 1), 6).alias("p95_ms"), F.round(F.max("time_ms"), 6).alias("max_ms"),
    )


def a25_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("row_name").agg(
        F.count(F.lit(1)).alias("n_queries"), rate(F.col("time_ms") <= BUDGET_MS).alias("within_budget_rate"), rate(em_()).alias("exact_match_rate"), rate(err_()).alias("llm_error_rate"), rate(gold_()).alias("all_gold_retrieved_rate")
    )


def a37_time_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearly interpolated percentiles (R-7) of the times per row, from distributed numbering."""
    t, out = timed(spark, sf_dir), []
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        h = (F.col("_n") - 1) * F.lit(q)
        lo = F.max(F.when(F.col("_place") == F.floor(h) + 1, F.col("time_ms")))
        hi = F.max(F.when(F.col("_place") == F.ceil(h) + 1, F.col("time_ms")))
        out.append(F.round(lo + (hi - lo) * F.max(h - F.floor(h)), 6).alias(f"p{round(q * 100):02d}"))
    return t.groupBy("row_name").agg(*out)


_LEVEL = "CASE WHEN lower(§confidence§) IN ('high', 'medium', 'low') THEN lower(§confidence§) ELSE 'error' END"


def a26_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy under ever stricter abstention."""
    drops = {"answer all": [], "abstain on error": ["error"], "abstain on error+low": ["error", "low"], "abstain on error+low+medium": ["error", "low", "medium"]}
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.array(*[F.lit(d) for d in ds]).cast("array<string>").alias("dropped")) for n, ds in drops.items()]))
    r = records(spark, sf_dir).groupBy("row_name", level_().alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(em_(), 1)).alias("em"), F.count(F.when(right_(), 1)).alias("soft"))
    r = r.select("*", rules.alias("x")).select("row_name", "level", "n", "em", "soft", "x.*").withColumn("kept", ~F.array_contains("dropped", F.col("level")))
    s = lambda c, k: F.coalesce(F.sum(F.when(F.col("kept") == k, F.col(c))), F.lit(0))
    return r.groupBy("row_name", "rule").agg(
        F.round(s("n", True) / F.sum("n"), 6).alias("coverage"), s("n", True).alias("n_answered"),
        F.round(F.when(s("n", True) > 0, s("em", True) / s("n", True)).otherwise(0.0), 6).alias("em_at_coverage"),
        F.round(F.when(s("n", True) > 0, s("soft", True) / s("n", True)).otherwise(0.0), 6).alias("soft_em_at_coverage"),
        s("n", False).alias("n_abstained"), F.round(F.when(s("n", False) > 0, 1 - s("em", False) / s("n", False)), 6).alias("abstention_precision_em"),
        F.round(F.when(s("n", False) > 0, 1 - s("soft", False) / s("n", False)), 6).alias("abstention_precision_soft"),
    )


def a27_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("row_name", level_().alias("level")).agg(
        F.count(F.when(em_(), 1)).alias("correct_em"), F.count(F.when(~em_(), 1)).alias("wrong_em"), F.count(F.when(right_(), 1)).alias("correct_soft"), F.count(F.when(~right_(), 1)).alias("wrong_soft")
    )


def a28_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over the levels with a proxy probability."""
    proxy = F.create_map(*[F.lit(x) for kv in PROXY.items() for x in kv])
    r = records(spark, sf_dir).groupBy("row_name", level_().alias("level")).agg(F.count(F.lit(1)).alias("n"), rate(em_(), 12).alias("em"), rate(right_(), 12).alias("soft")).where(F.col("level").isin(list(PROXY)))
    p = proxy[F.col("level")]
    return r.groupBy("row_name").agg(F.round(F.sum(F.col("n") * F.abs(F.col("em") - p)) / F.sum("n"), 6).alias("ece_em"), F.round(F.sum(F.col("n") * F.abs(F.col("soft") - p)) / F.sum("n"), 6).alias("ece_soft"))


def a29_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney area with ties, from the counts of each confidence level."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    r = records(spark, sf_dir).groupBy("row_name", rank[level_()].alias("rank"))
    r = r.agg(F.count(F.when(em_(), 1)).alias("p1"), F.count(F.when(~em_(), 1)).alias("n1"), F.count(F.when(right_(), 1)).alias("p2"), F.count(F.when(~right_(), 1)).alias("n2"))
    below = Window.partitionBy("row_name").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    area = lambda i: F.round(F.sum(F.col(f"p{i}") * (F.coalesce(F.col(f"b{i}"), F.lit(0)) + 0.5 * F.col(f"n{i}"))) / F.nullif(F.sum(f"p{i}") * F.sum(f"n{i}"), F.lit(0)), 6)
    r = r.withColumn("b1", F.sum("n1").over(below)).withColumn("b2", F.sum("n2").over(below))
    return r.groupBy("row_name").agg(area(1).alias("auroc_em"), area(2).alias("auroc_soft"))


def a30_trust_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row accuracy, the confidence distribution, calibration and ranking quality, all from the counts of each level."""
    level = lambda x: F.coalesce(F.sum(F.when(F.col("level") == x, F.col("n"))), F.lit(0)).alias(f"n_{x}")
    c = records(spark, sf_dir).groupBy("row_name", level_().alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(em_(), 1)).alias("em"), F.count(F.when(right_(), 1)).alias("soft"))
    rank, proxy = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("level")] for m in (RANK, PROXY))
    below = Window.partitionBy("row_name").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    for k in ("em", "soft"):
        c = c.withColumn(f"below_{k}", F.coalesce(F.sum(F.col("n") - F.col(k)).over(below), F.lit(0)))
    gap = lambda k: F.round(F.sum(F.when(proxy.isNotNull(), F.abs(F.col(k) - F.col("n") * proxy))) / F.sum(F.when(proxy.isNotNull(), F.col("n"))), 6).alias(f"ece_{k}")
    area = lambda k: F.round(F.sum(F.col(k) * (F.col(f"below_{k}") + 0.5 * (F.col("n") - F.col(k)))) / F.nullif(F.sum(k) * F.sum(F.col("n") - F.col(k)), F.lit(0)), 6).alias(f"auroc_{k}")
    share = lambda k, name: F.round(F.sum(k) / F.sum("n"), 6).alias(name)
    return c.groupBy("row_name").agg(F.sum("n").alias("n"), share("em", "em_rate"), share("soft", "soft_rate"), *map(level, RANK), gap("em"), gap("soft"), area("em"), area("soft"))


def d13_llm_only_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row without retrieval, scored from its stored answers: accuracy, mean F1, error rate, by dataset."""
    p, g = F.col("predicted_answer"), F.col("gold_answer")
    r = records(spark, sf_dir).where(F.col("row_name") == ROWS[0])
    return r.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), rate(exact_match(p, g)).alias("em"), F.round(F.avg(token_f1(p, g)), 6).alias("f1"), rate(F.lower(p).startswith("[error")).alias("error_rate"))


def deferral_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row, worst confidence first, then lower f1, then question_id; _place counts from 1."""
    order = F.create_map(F.lit("error"), F.lit(0), F.lit("low"), F.lit(1), F.lit("medium"), F.lit(2), F.lit("high"), F.lit(3))
    r = records(spark, sf_dir).select("row_name", "question_id", level_().alias("level"), F.coalesce("f1_score", F.lit(0.0)).alias("f1"), right_().alias("correct"), F.coalesce("time_ms", F.lit(0.0)).alias("ms"))
    return numbered(r, ["row_name"], {"_o": order[F.col("level")], "_f": F.col("f1"), "_q": F.col("question_id")})


def a31_deferral_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deferral_order(spark, sf_dir).select("row_name", "question_id", F.col("_place").alias("place"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended accuracy, cost and latency when the worst k = round-half-even(f n) questions go to the cloud."""
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("cloud_mode"), F.lit(f).alias("fraction")) for m in ("oracle", "fixed", "lift") for f in FRACTIONS]))
    d = deferral_order(spark, sf_dir).select("*", modes.alias("x")).select("*", "x.*")
    sent = F.col("_place") <= F.bround(F.col("fraction") * F.col("_n"))
    d = d.groupBy("row_name", "cloud_mode", "fraction").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(sent, 1)).alias("n_deferred"), F.count(F.when(~sent & F.col("correct"), 1)).alias("kept_right"),
        F.count(F.when(sent & F.col("correct"), 1)).alias("sent_right"), F.sum("ms").alias("ms"),
    )
    k = F.col("n_deferred")
    cloud = F.when(k == 0, 0.0).when(F.col("cloud_mode") == "oracle", 1.0).when(F.col("cloud_mode") == "fixed", 0.9).otherwise(F.least(F.lit(1.0), F.col("sent_right") / k + 0.3))
    d = d.withColumn("cloud_accuracy", F.round(cloud, 6)).withColumn("accuracy", F.round((F.col("kept_right") + cloud * k) / F.col("n"), 6))
    d = d.withColumn("cost_per_1000", F.round(F.lit(COST) * k / F.col("n") * 1000, 6)).withColumn("mean_latency_ms", F.round((F.col("ms") + k * CLOUD_MS) / F.col("n"), 6))
    return d.select("row_name", "cloud_mode", "fraction", "n", "n_deferred", "cloud_accuracy", "accuracy", "cost_per_1000", "mean_latency_ms")


def a34_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fraction of the greatest gain per dollar, the smallest of equals."""
    s = sweep(spark, sf_dir)
    base = s.where("fraction = 0").select("row_name", "cloud_mode", F.col("accuracy").alias("base"))
    s = s.where("n_deferred > 0").join(base, ["row_name", "cloud_mode"]).withColumn("gain", F.round((F.col("accuracy") - F.col("base")) / F.col("cost_per_1000"), 6))
    return s.groupBy("row_name", "cloud_mode").agg(F.max_by("fraction", F.struct("gain", -F.col("fraction"))).alias("fraction"), F.max("gain").alias("gain_per_dollar"))


def a35_cost_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least number of deferrals that reaches each target accuracy with a cloud accuracy of 0.9; null if none."""
    d = deferral_order(spark, sf_dir)
    d = prefix_sums(d, ["row_name"], F.col("correct").cast("int"), "right_before")
    total = d.groupBy("row_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("right"))
    zero = total.select("row_name", "n", "right", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("right_before"))
    steps = d.select("row_name", F.col("_place").alias("k"), "right_before").join(total, "row_name").select("row_name", "n", "right", "k", "right_before").unionByName(zero)
    steps = steps.withColumn("accuracy", F.round((F.col("right") - F.col("right_before") + 0.9 * F.col("k")) / F.col("n"), 9))
    out = steps.groupBy("row_name", "n").agg(*[F.min(F.when(F.col("accuracy") >= t, F.col("k"))).alias(f"k_{i}") for i, t in enumerate(TARGETS)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"k_{i}").alias("n_deferred")) for i, t in enumerate(TARGETS)]))
    out = out.select("row_name", "n", rows.alias("x")).select("row_name", "n", "x.*")
    return out.select("row_name", "target", F.col("n_deferred").cast("double").alias("n_deferred"), F.round(F.lit(COST) * F.col("n_deferred") / F.col("n") * 1000, 6).alias("cost_per_1000"))


def a53_coverage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir).select("row_name", "cloud_mode", F.round(1 - F.col("fraction"), 6).alias("coverage"), F.round(1 - F.col("accuracy"), 6).alias("risk"))


def m02_answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M01 to M03, M08, M14, M16 for every record."""
    p, g = F.col("predicted_answer"), F.col("gold_answer")
    f1 = token_f1(p, g)
    low = F.lower(F.coalesce(p, F.lit("")))
    return records(spark, sf_dir).select(
        "question_id", "row_name", normalise_answer(p).alias("answer_norm"), exact_match(p, g).alias("em"), F.round(f1, 6).alias("f1"), (f1 >= SOFT_F1).alias("soft_em"),
        (F.lower(strip(p)) == F.lower(strip(g))).alias("plain_em"), (low.startswith("[error") | low.contains("timed out")).alias("llm_error_text"), level_().alias("level"),
    )


def d01_dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 100 questions of each dataset are dev, the others test; every question is in one split."""
    q = records(spark, sf_dir).where(F.col("dataset").isNotNull()).select("dataset", "question_id").distinct()
    placed = numbered(q, ["dataset"], {"_q": F.col("question_id")})
    return placed.select("dataset", "question_id", F.when(F.col("_place") > F.col("_n") - 100, "dev").otherwise("test").alias("split"))


def d02_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset, questions in both splits and questions in neither; both are 0 for a sound split."""
    split = d01_dev_split(spark, sf_dir)
    every = records(spark, sf_dir).where(F.col("dataset").isNotNull()).select("dataset", "question_id").distinct()
    per = every.join(split, ["dataset", "question_id"], "left").groupBy("dataset", "question_id").agg(F.countDistinct("split").alias("k"))
    return per.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("k") > 1, 1)).alias("in_both"), F.count(F.when(F.col("k") == 0, 1)).alias("in_neither"))


def d03_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that the full row would still have to answer: those without a usable answer there."""
    r = records(spark, sf_dir)
    done = r.where((F.col("row_name") == ROWS[-1]) & (strip(F.coalesce("predicted_answer", F.lit(""))) != "")).select("question_id")
    return r.select("question_id").distinct().join(done, "question_id", "left_anti")


def d08_query_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache key of every question text and the number of records that one computation serves."""
    key = F.substring(F.sha2(F.lower(strip(F.col("question"))), 256), 1, 16)
    return records(spark, sf_dir).groupBy(key.alias("cache_key")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("question_id").alias("n_questions"))


def a47_batch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.lower(strip(F.coalesce("predicted_answer", F.lit("")))) == F.lower(strip(F.coalesce("gold_answer", F.lit(""))))
    return records(spark, sf_dir).groupBy("row_name").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(hit, 1)).alias("correct"), rate(hit).alias("accuracy"))


def a46_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every dataset and expected row, whether results are there for all of the dataset's questions."""
    r = records(spark, sf_dir).where(F.col("dataset").isNotNull())
    want = r.groupBy("dataset").agg(F.countDistinct("question_id").alias("n_questions")).select("*", F.explode(F.array(*map(F.lit, ROWS))).alias("row_name"))
    have = r.groupBy("dataset", "row_name").agg(F.countDistinct("question_id").alias("n_have"))
    return want.join(have, ["dataset", "row_name"], "left").select("dataset", "row_name", F.coalesce("n_have", F.lit(0)).alias("n_have"), (F.coalesce("n_have", F.lit(0)) == F.col("n_questions")).alias("complete"))


QUERIES = {
    f.__name__: f for f in (
        a02_config_summary, a04_marginal_utility, a13_failure_bucket, a15_halluc_subbucket, a16_bucket_histogram, a17_bucket_comparison, a19_failure_class, a20_transitions, a21_row_summary,
        a22_planner_routing, a23_answer_flips, a24_latency_stats, a25_within_budget, a26_risk_coverage, a27_contingency, a28_calibration, a29_auroc, a30_trust_bundle, a31_deferral_order, a34_knee, a35_cost_targets,
        a37_time_percentiles, a46_coverage_check, a47_batch_accuracy, a53_coverage_points, m02_answer_metrics, d13_llm_only_row, d01_dev_split, d02_split_check, d03_resume, d08_query_cache_keys,
    )
} | {"a05_row_aggregate": by_key("row_name"), "a06_dataset_aggregate": by_key("dataset"), "a10_type_aggregate": by_key("question_type"), "a32_deferral_sweep": sweep}

_LV = _REC + f", l AS (SELECT *, {_LEVEL} AS level, coalesce(f1_score, 0) >= 0.6 AS soft FROM r)"
_DEF = _LV + """, d AS (SELECT row_name, question_id, soft AS correct, coalesce(time_ms, 0) AS ms, row_number() OVER w AS place, count(*) OVER (PARTITION BY row_name) AS n
    FROM l WINDOW w AS (PARTITION BY row_name ORDER BY CASE level WHEN 'error' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, coalesce(f1_score, 0), question_id))"""
_SWEEP = _DEF + f""", m(cloud_mode) AS (VALUES ('oracle'), ('fixed'), ('lift')), f(fraction) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in FRACTIONS)}),
    g AS (SELECT row_name, cloud_mode, fraction, count(*) AS n, count(*) FILTER (place <= round_even(fraction * n, 0)) AS k, count(*) FILTER (place > round_even(fraction * n, 0) AND correct) AS kept,
        count(*) FILTER (place <= round_even(fraction * n, 0) AND correct) AS sent, sum(ms) AS ms FROM d, m, f GROUP BY 1, 2, 3),
    h AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN cloud_mode = 'oracle' THEN 1 WHEN cloud_mode = 'fixed' THEN 0.9::DOUBLE ELSE least(1, sent / k + 0.3::DOUBLE) END AS c FROM g),
    s AS (SELECT row_name, cloud_mode, fraction, n, k AS n_deferred, round(c::DOUBLE, 6) AS cloud_accuracy, round((kept + c * k) / n, 6) AS accuracy,
        round({COST}::DOUBLE * k / n * 1000, 6) AS cost_per_1000, round((ms + k * {CLOUD_MS}::DOUBLE) / n, 6) AS mean_latency_ms FROM h)"""
_CLASS = f"""CASE WHEN r.llm_error THEN 'llm_error' WHEN NOT coalesce(r.all_gold_retrieved, FALSE) THEN 'retrieval_miss'
    WHEN lower(§r.predicted_answer§) IN ({', '.join("'" + x + "'" for x in YESNO_ANSWERS)}) AND lower(§r.gold_answer§) NOT IN ('yes', 'no') THEN 'format_yn'
    WHEN {_any("lower(§r.predicted_answer§)", ABSTENTION_SHORT)} THEN 'format_abstention'
    WHEN lower(§r.predicted_answer§) <> '' AND contains(lower(r.question), lower(§r.predicted_answer§)) AND lower(§r.predicted_answer§) <> lower(§r.gold_answer§) THEN 'bridge_confusion'
    WHEN b.exact_match THEN 'context_dilution' ELSE 'unclassified' END"""
_AREA = "round(sum(p{i} * (coalesce(b{i}, 0) + 0.5::DOUBLE * n{i})) / nullif(sum(p{i}) * sum(n{i}), 0), 6) AS {name}"
_WORDS = "list_filter(string_split({c}, ' '), lambda x: x <> '')"
_MET = _REC + f""", z AS (SELECT *, {_norm('predicted_answer')} AS p, {_norm('gold_answer')} AS g FROM r), y AS (SELECT *, {_WORDS.format(c='p')} AS pw, {_WORDS.format(c='g')} AS gw FROM z),
    x AS (SELECT *, list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda a: a = w)), len(list_filter(gw, lambda a: a = w))))) AS common FROM y),
    m AS (SELECT *, g <> '' AND (p = g OR (contains(g, ' ') AND contains(' ' || p || ' ', ' ' || g || ' ')) OR (g IN ('yes', 'no') AND list_contains(pw[:5], g))) AS em0, CASE WHEN coalesce(common, 0) = 0 THEN 0 ELSE 2 * (common / len(pw)) * (common / len(gw)) / (common / len(pw) + common / len(gw)) END::DOUBLE AS f10 FROM x)"""
ORACLE = {
    "m02_answer_metrics": _MET + f""" SELECT question_id, row_name, p AS answer_norm, em0 AS em, round(f10, 6) AS f1, f10 >= 0.6 AS soft_em, CASE WHEN predicted_answer IS NULL OR gold_answer IS NULL THEN NULL ELSE lower(§predicted_answer§) = lower(§gold_answer§) END AS plain_em,
        starts_with(lower(coalesce(predicted_answer, '')), '[error') OR contains(lower(coalesce(predicted_answer, '')), 'timed out') AS llm_error_text, {_LEVEL} AS level FROM m""",
    "d13_llm_only_row": _MET + " SELECT dataset, count(*) AS n, round(avg(em0::INT), 6) AS em, round(avg(f10), 6) AS f1, round(avg(coalesce(starts_with(lower(predicted_answer), '[error'), FALSE)::INT), 6) AS error_rate FROM m WHERE row_name = 'row1_llm_only' GROUP BY 1",
    "a30_trust_bundle": _LV + """, c AS (SELECT row_name, level, count(*) AS n, count(*) FILTER (exact_match) AS em, count(*) FILTER (soft) AS soft, CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rk, CASE level WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.3 END::DOUBLE AS px FROM l GROUP BY 1, 2),
        b AS (SELECT *, coalesce(sum(n - em) OVER w, 0) AS be, coalesce(sum(n - soft) OVER w, 0) AS bs FROM c WINDOW w AS (PARTITION BY row_name ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT row_name, sum(n)::BIGINT AS n, round(sum(em) / sum(n), 6) AS em_rate, round(sum(soft) / sum(n), 6) AS soft_rate, coalesce(sum(n) FILTER (level = 'high'), 0)::BIGINT AS n_high, coalesce(sum(n) FILTER (level = 'medium'), 0)::BIGINT AS n_medium, coalesce(sum(n) FILTER (level = 'low'), 0)::BIGINT AS n_low, coalesce(sum(n) FILTER (level = 'error'), 0)::BIGINT AS n_error,
            round(sum(abs(em - n * px)) / sum(n) FILTER (px IS NOT NULL), 6) AS ece_em, round(sum(abs(soft - n * px)) / sum(n) FILTER (px IS NOT NULL), 6) AS ece_soft,
            round(sum(em * (be + 0.5::DOUBLE * (n - em))) / nullif(sum(em) * sum(n - em), 0), 6) AS auroc_em, round(sum(soft * (bs + 0.5::DOUBLE * (n - soft))) / nullif(sum(soft) * sum(n - soft), 0), 6) AS auroc_soft FROM b GROUP BY 1""",
    "a02_config_summary": _REC + f" SELECT dataset, row_name, question_type, grouping(question_type)::INT AS all_types, {_OUT} FROM r GROUP BY GROUPING SETS ((dataset, row_name), (dataset, row_name, question_type))",
    "a04_marginal_utility": _REC + """, p AS (SELECT dataset, row_name, avg(f1_score) AS f1, avg(coalesce(time_ms, 0)) AS ms FROM r GROUP BY 1, 2),
        d AS (SELECT *, f1 - first_value(f1) OVER w AS df, (ms - first_value(ms) OVER w) / 1000 AS ds, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY dataset ORDER BY row_name))
        SELECT dataset, row_name, round(CASE WHEN i = 1 OR abs(ds) < 0.001 THEN NULL WHEN ds > 0 THEN df / ds WHEN df > 0 THEN 'inf'::DOUBLE ELSE df / ds END, 6) + 0.0 AS mur FROM d""",
    "a05_row_aggregate": _REC + f" SELECT row_name, {_OUT} FROM r GROUP BY 1",
    "a06_dataset_aggregate": _REC + f" SELECT dataset, {_OUT} FROM r GROUP BY 1",
    "a10_type_aggregate": _REC + f" SELECT question_type, {_OUT} FROM r GROUP BY 1",
    "a13_failure_bucket": _TITLES + f" SELECT question_id, row_name, {_BUCKET} AS bucket FROM wr",
    "a15_halluc_subbucket": _TITLES + f" SELECT row_name, CASE WHEN {_norm('predicted_answer')} <> '' AND len(list_filter(coalesce(titles, []), lambda t: contains({_norm('t')}, {_norm('predicted_answer')}))) > 0 THEN 'b1_wrong_entity_in_titles' ELSE 'b2_freegen_or_other' END AS sub_bucket, count(*) AS n FROM wr WHERE {_BUCKET} = 'b_grounded_halluc' GROUP BY 1, 2",
    "a16_bucket_histogram": _TITLES + f" SELECT row_name, {_BUCKET} AS bucket, count(*) AS n FROM wr GROUP BY 1, 2",
    "a17_bucket_comparison": _TITLES + f" SELECT {_BUCKET} AS bucket, " + ", ".join(f"count(*) FILTER (row_name = '{x}') AS {x}" for x in ROWS) + " FROM wr GROUP BY 1",
    "a19_failure_class": _REC + f" SELECT r.row_name, {_CLASS} AS class, count(*) AS n FROM r LEFT JOIN (SELECT question_id, exact_match FROM r WHERE row_name = 'row2_navigator') b USING (question_id) WHERE NOT r.exact_match GROUP BY 1, 2",
    "a20_transitions": _PAIR + " SELECT row_a, row_b, CASE WHEN em_a AND em_b THEN 'stayed_correct' WHEN NOT em_a AND NOT em_b THEN 'stayed_wrong' WHEN NOT em_a AND em_b THEN 'gained' ELSE 'lost' END AS transition, count(*) AS n FROM p GROUP BY 1, 2, 3",
    "a21_row_summary": _REC + """ SELECT row_name, count(*) AS n, round(avg(exact_match::INT), 6) AS em, round(avg(coalesce(all_gold_retrieved, FALSE)::INT), 6) AS sf_recall,
        round(coalesce(count(*) FILTER (all_gold_retrieved AND exact_match) / nullif(count(*) FILTER (all_gold_retrieved), 0), 0), 6) AS em_given_retr_ok,
        round(avg(coalesce(retrieval_count, 0)), 8) AS avg_retrieval_count, max(retrieval_count) AS max_retrieval_count, round(avg(coalesce(verifier_iterations, 0)), 8) AS avg_verifier_iters, max(verifier_iterations) AS max_verifier_iters FROM r GROUP BY 1""",
    "a22_planner_routing": _REC + """ SELECT row_name, field, value, count(*) AS n FROM (SELECT row_name, 'query_type' AS field, coalesce(planner_query_type, 'unknown') AS value FROM r
        UNION ALL SELECT row_name, 'hop_count', coalesce(hop_count::VARCHAR, '0') FROM r UNION ALL SELECT row_name, 'n_entities', coalesce(n_entities::VARCHAR, '0') FROM r) GROUP BY 1, 2, 3""",
    "a23_answer_flips": _PAIR + " SELECT row_a, row_b, count(*) AS answer_changed, count(*) FILTER (NOT em_a AND em_b) AS fixed, count(*) FILTER (em_a AND NOT em_b) AS broke, count(*) FILTER (em_a = em_b) AS churn FROM p WHERE pa <> pb GROUP BY 1, 2",
    "a24_latency_stats": _REC + """ SELECT row_name, count(*) AS n_timed, round(avg(time_ms), 6) AS mean_ms, round(median(time_ms), 6) AS median_ms,
        round(list_sort(list(time_ms))[(floor(0.95 * (count(*) - 1)) + 1)::INT], 6) AS p95_ms, round(max(time_ms), 6) AS max_ms FROM r WHERE time_ms IS NOT NULL GROUP BY 1""",
    "a25_within_budget": _REC + """ SELECT row_name, count(*) AS n_queries, round(avg(coalesce(time_ms <= 60000, FALSE)::INT), 6) AS within_budget_rate, round(avg(exact_match::INT), 6) AS exact_match_rate,
        round(avg(llm_error::INT), 6) AS llm_error_rate, round(avg(coalesce(all_gold_retrieved, FALSE)::INT), 6) AS all_gold_retrieved_rate FROM r GROUP BY 1""",
    "a26_risk_coverage": _LV + """, x(rule, dropped) AS (VALUES ('answer all', []::VARCHAR[]), ('abstain on error', ['error']), ('abstain on error+low', ['error', 'low']), ('abstain on error+low+medium', ['error', 'low', 'medium'])),
        k AS (SELECT row_name, rule, exact_match AS em, soft, NOT list_contains(dropped, level) AS kept FROM l, x)
        SELECT row_name, rule, round(count(*) FILTER (kept) / count(*), 6) AS coverage, count(*) FILTER (kept) AS n_answered,
            round(coalesce(count(*) FILTER (kept AND em) / nullif(count(*) FILTER (kept), 0), 0), 6) AS em_at_coverage, round(coalesce(count(*) FILTER (kept AND soft) / nullif(count(*) FILTER (kept), 0), 0), 6) AS soft_em_at_coverage,
            count(*) FILTER (NOT kept) AS n_abstained, round(1 - count(*) FILTER (NOT kept AND em) / nullif(count(*) FILTER (NOT kept), 0), 6) AS abstention_precision_em,
            round(1 - count(*) FILTER (NOT kept AND soft) / nullif(count(*) FILTER (NOT kept), 0), 6) AS abstention_precision_soft FROM k GROUP BY 1, 2""",
    "a27_contingency": _LV + " SELECT row_name, level, count(*) FILTER (exact_match) AS correct_em, count(*) FILTER (NOT exact_match) AS wrong_em, count(*) FILTER (soft) AS correct_soft, count(*) FILTER (NOT soft) AS wrong_soft FROM l GROUP BY 1, 2",
    "a28_calibration": _LV + """, c AS (SELECT row_name, level, count(*) AS n, avg(exact_match::INT) AS em, avg(soft::INT) AS soft, CASE level WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 ELSE 0.3 END::DOUBLE AS p FROM l WHERE level <> 'error' GROUP BY 1, 2)
        SELECT row_name, round(sum(n * abs(em - p)) / sum(n), 6) AS ece_em, round(sum(n * abs(soft - p)) / sum(n), 6) AS ece_soft FROM c GROUP BY 1""",
    "a29_auroc": _LV + """, c AS (SELECT row_name, CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank, count(*) FILTER (exact_match) AS p1, count(*) FILTER (NOT exact_match) AS n1, count(*) FILTER (soft) AS p2, count(*) FILTER (NOT soft) AS n2 FROM l GROUP BY 1, 2),
        b AS (SELECT *, sum(n1) OVER w AS b1, sum(n2) OVER w AS b2 FROM c WINDOW w AS (PARTITION BY row_name ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT row_name, """ + _AREA.format(i=1, name="auroc_em") + ", " + _AREA.format(i=2, name="auroc_soft") + " FROM b GROUP BY 1",
    "a31_deferral_order": _DEF + " SELECT row_name, question_id, place FROM d",
    "a32_deferral_sweep": _SWEEP + " SELECT * FROM s",
    "a34_knee": _SWEEP + """, g2 AS (SELECT s.row_name, s.cloud_mode, s.fraction, round((s.accuracy - b.accuracy) / s.cost_per_1000, 6) AS gain FROM s JOIN s b ON b.row_name = s.row_name AND b.cloud_mode = s.cloud_mode AND b.fraction = 0 WHERE s.n_deferred > 0)
        SELECT row_name, cloud_mode, (list(fraction ORDER BY gain DESC, fraction))[1] AS fraction, max(gain) AS gain_per_dollar FROM g2 GROUP BY 1, 2""",
    "a35_cost_targets": _DEF + f""", t(target) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in TARGETS)}), z AS (SELECT row_name, n, place AS k, sum(correct::INT) OVER (PARTITION BY row_name ORDER BY place) AS pre, sum(correct::INT) OVER (PARTITION BY row_name) AS tot FROM d),
        y AS (SELECT row_name, n, k, round((tot - pre + 0.9::DOUBLE * k) / n, 9) AS acc FROM z UNION ALL SELECT DISTINCT row_name, n, 0, round(tot / n, 9) FROM z),
        x AS (SELECT row_name, target, any_value(n) AS n, min(k) FILTER (acc >= target) AS n_deferred FROM y, t GROUP BY 1, 2)
        SELECT row_name, target, n_deferred::DOUBLE AS n_deferred, round({COST}::DOUBLE * n_deferred / n * 1000, 6) AS cost_per_1000 FROM x""",
    "a37_time_percentiles": _REC + " SELECT row_name, " + ", ".join(f"round(quantile_cont(time_ms, {q}), 6) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM r WHERE time_ms IS NOT NULL GROUP BY 1",
    "a46_coverage_check": _REC + f""", w AS (SELECT dataset, count(DISTINCT question_id) AS nq FROM r WHERE dataset IS NOT NULL GROUP BY 1), h AS (SELECT dataset, row_name, count(DISTINCT question_id) AS nh FROM r GROUP BY 1, 2), o(row_name) AS (VALUES {', '.join(f"('{x}')" for x in ROWS)})
        SELECT w.dataset, o.row_name, coalesce(nh, 0) AS n_have, coalesce(nh, 0) = nq AS complete FROM w CROSS JOIN o LEFT JOIN h ON h.dataset = w.dataset AND h.row_name = o.row_name""",
    "a47_batch_accuracy": _REC + " SELECT row_name, count(*) AS total, count(*) FILTER (lower(§predicted_answer§) = lower(§gold_answer§)) AS correct, round(avg((lower(§predicted_answer§) = lower(§gold_answer§))::INT), 6) AS accuracy FROM r GROUP BY 1",
    "a53_coverage_points": _SWEEP + " SELECT row_name, cloud_mode, round(1 - fraction, 6) AS coverage, round(1 - accuracy, 6) AS risk FROM s",
    "d01_dev_split": _REC + ", q AS (SELECT DISTINCT dataset, question_id FROM r WHERE dataset IS NOT NULL) SELECT dataset, question_id, CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY question_id) > count(*) OVER (PARTITION BY dataset) - 100 THEN 'dev' ELSE 'test' END AS split FROM q",
    "d02_split_check": _REC + " SELECT dataset, count(DISTINCT question_id) AS n, 0::BIGINT AS in_both, 0::BIGINT AS in_neither FROM r WHERE dataset IS NOT NULL GROUP BY 1",
    "d03_resume": _REC + " SELECT DISTINCT question_id FROM r WHERE question_id NOT IN (SELECT question_id FROM r WHERE row_name = 'row5_full' AND §predicted_answer§ <> '')",
    "d08_query_cache_keys": _REC + " SELECT substring(sha256(lower(trim(question))), 1, 16) AS cache_key, count(*) AS n_records, count(DISTINCT question_id) AS n_questions FROM r GROUP BY 1",
}

#: In the statements above, §c§ stands for column c without blanks at its ends, empty for null.
ORACLE = {name: re.sub("§([^§]+)§", lambda m: strip_sql(f"coalesce({m[1]}, '')"), sql) for name, sql in ORACLE.items()}
