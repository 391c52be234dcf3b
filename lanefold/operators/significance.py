"""Bootstrap intervals, paired tests and step-down correction over evaluation records.

Resampling is Poisson-weighted: a question has a weight of its own in each of RESAMPLES resamples, drawn from a hash of
its id, so no question list is gathered or indexed, results repeat on any partitioning, and rows of the same question
are resampled together (the paired design). Means are normalised by the weights' sum. A task multiplies its questions'
values by their weights as matrices and hands on one array of sums per measure and block of resamples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.operators.evaluation import ROWS, records

RESAMPLES, ALPHA, BLOCK, QUESTIONS = 10_000, 0.05, 1000, 128
METRICS = ("em", "f1", "sf_f1", "sf_recall")
#: comparisons of adjacent rows
ADJACENT = list(zip(ROWS, ROWS[1:]))
#: Cumulative probabilities of a Poisson count of mean 1, up to 7.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
#: The prime field in which weights are drawn.
PRIME = 2147483647


def weights(first: np.ndarray, second: np.ndarray, resamples: int) -> np.ndarray:
    """questions x resamples Poisson(1) counts from two hash values of each question; all products stay below 2^62."""
    b = np.arange(1, resamples + 1, dtype=np.int64)
    h, g = first[:, None], second[:, None]
    x = (h + b) % PRIME * ((g + 48271 * b) % PRIME) % PRIME
    x = x * ((x + g) % PRIME) % PRIME
    return np.searchsorted(POISSON, x / float(PRIME), side="right").astype(np.float64)


def hashes(key: Column) -> list[Column]:
    """Two numbers below PRIME from the MD5 of a question's id."""
    part = lambda at: F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("long") % PRIME
    return [part(1).alias("h"), part(9).alias("g")]


def sf_f1() -> Column:
    """Harmonic mean of retrieval precision and recall, 0 where both are 0 or missing."""
    p, r = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("retrieval_precision", "retrieval_recall"))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def wide_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question with a column metric|row for each, null where the row lacks the question."""
    r = records(spark, sf_dir).where(F.col("question_id").isNotNull())
    value = {"em": F.coalesce(F.col("exact_match").cast("int").cast("double"), F.lit(0.0)), "f1": F.coalesce("f1_score", F.lit(0.0)), "sf_f1": sf_f1(), "sf_recall": F.coalesce("retrieval_recall", F.lit(0.0))}
    r = r.select("question_id", "row_name", *[c.alias(m) for m, c in value.items()])
    return r.groupBy("question_id").agg(*[F.max(F.when(F.col("row_name") == n, F.col(m))).alias(f"{m}|{n}") for m in METRICS for n in ROWS])


def resampled(values: DataFrame, columns: dict[str, Column], resamples: int) -> DataFrame:
    """(key, b, mean): the weighted mean of each column in each resample, over the questions where it is not null."""
    names = list(columns)
    rows = values.select(*hashes(F.col("question_id")), *[c.alias(n) for n, c in columns.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(names), resamples))
        for batch in batches:
            for at in range(0, len(batch), QUESTIONS):
                part = batch.iloc[at : at + QUESTIONS]
                w = weights(part["h"].to_numpy(np.int64), part["g"].to_numpy(np.int64), resamples)
                v = part[names].to_numpy(np.float64)
                total[0] += np.nan_to_num(v).T @ w
                total[1] += (~np.isnan(v)).astype(float).T @ w
        out = [(n, lo, total[0, i, lo : lo + BLOCK].tolist(), total[1, i, lo : lo + BLOCK].tolist()) for i, n in enumerate(names) for lo in range(0, resamples, BLOCK)]
        yield pd.DataFrame(out, columns=["key", "block", "s", "w"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        s, w = (np.sum(group[c].tolist(), axis=0) for c in ("s", "w"))
        some = w > 0
        return pd.DataFrame({"key": group["key"].iloc[0], "b": group["block"].iloc[0] + np.flatnonzero(some), "mean": s[some] / w[some]})

    parts = rows.mapInPandas(run, "key string, block int, s array<double>, w array<double>")
    return parts.groupBy("key", "block").applyInPandas(add, "key string, b int, mean double")


def interval(c: str) -> list[Column]:
    return [F.round(F.percentile(c, 0.025), 9).alias("ci_low"), F.round(F.percentile(c, 0.975), 9).alias("ci_high")]


def points(values: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(key, n, value): number of questions and plain mean of each column."""
    sides = values.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), c.alias("v")) for k, c in columns.items()])).alias("x"))
    return sides.where(F.col("x.v").isNotNull()).groupBy("x.key").agg(F.count(F.lit(1)).alias("n"), F.avg("x.v").alias("value"))


def bootstrap_ci(values: DataFrame, columns: dict[str, Column], resamples: int = RESAMPLES) -> DataFrame:
    """(key, n, mean, ci_low, ci_high): mean and its 95 % interval; keys without a value have no row."""
    ci = resampled(values, columns, resamples).groupBy("key").agg(*interval("mean"))
    return points(values, columns).join(ci, "key").select("key", "n", F.round("value", 9).alias("mean"), "ci_low", "ci_high")


def paired_bootstrap(values: DataFrame, columns: dict[str, Column], resamples: int = RESAMPLES) -> DataFrame:
    """(key, n, delta, ci_low, ci_high, p_value) of difference columns over the questions that both sides have.

    p = (resamples whose distance to the observed difference is no smaller than the difference itself + 1) / (resamples + 1).
    """
    p = points(values, columns).select("key", "n", F.col("value").alias("delta"))
    r = resampled(values, columns, resamples).join(p, "key")
    far = F.round(F.abs(F.col("mean") - F.col("delta")), 9) >= F.round(F.abs("delta"), 9)
    g = r.groupBy("key", "n", "delta").agg(*interval("mean"), F.count(F.when(far, 1)).alias("extreme"))
    return g.select("key", "n", F.round("delta", 6).alias("delta"), "ci_low", "ci_high", F.round((F.col("extreme") + 1) / (resamples + 1), 6).alias("p_value"))


def single_columns() -> dict[str, Column]:
    return {f"{m}|{n}": F.col(f"`{m}|{n}`") for m in METRICS for n in ROWS}


def pair_columns(pairs: list[tuple[str, str]]) -> dict[str, Column]:
    return {f"{m}|{a}|{b}": F.col(f"`{m}|{b}`") - F.col(f"`{m}|{a}`") for m in METRICS for a, b in pairs}


def part(i: int, name: str) -> Column:
    return F.split("key", r"\|")[i].alias(name)


def a38_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's EM, F1, supporting-fact F1 and recall with their intervals."""
    return bootstrap_ci(wide_values(spark, sf_dir), single_columns()).select(part(0, "metric"), part(1, "row_name"), "n", "mean", "ci_low", "ci_high")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent rows on every metric."""
    t = paired_bootstrap(wide_values(spark, sf_dir), pair_columns(ADJACENT))
    return t.select(part(0, "metric"), part(1, "row_a"), part(2, "row_b"), "n", "delta", "ci_low", "ci_high", "p_value")


def holm(tests: DataFrame, p: str, tie: str, family: str, alpha: float = ALPHA) -> DataFrame:
    """Tests with holm_rank, p_adjusted and significant within each family (one row a comparison)."""
    w = Window.partitionBy(family).orderBy(p, tie)
    t = tests.withColumn("holm_rank", F.row_number().over(w))
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    t = t.withColumn("raw", F.least(F.lit(1.0), (m - F.col("holm_rank") + 1) * F.col(p)))
    return t.withColumn("p_adjusted", F.round(F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 6)).drop("raw").withColumn("significant", F.col("p_adjusted") <= alpha)


def a42_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjacent-row comparisons, corrected as one family a metric."""
    return holm(paired(spark, sf_dir), "p_value", "row_a", "metric")


def a44_sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's metric and interval, with its paired difference from the first row (null there), interval and p.

    A difference is significant where its interval leaves out zero.
    """
    v = wide_values(spark, sf_dir)
    base = [(ROWS[0], r) for r in ROWS[1:]]
    one = bootstrap_ci(v, single_columns()).select(part(0, "metric"), part(1, "row_name"), "n", F.col("mean").alias("point"), "ci_low", "ci_high")
    two = paired_bootstrap(v, pair_columns(base)).select(part(0, "metric"), part(2, "row_name"), "delta", F.col("ci_low").alias("delta_ci_low"), F.col("ci_high").alias("delta_ci_high"), "p_value")
    out = one.join(two, ["metric", "row_name"], "left").withColumn("is_baseline", F.col("row_name") == ROWS[0])
    return out.withColumn("significant", (F.col("delta_ci_low") > 0) | (F.col("delta_ci_high") < 0))


QUERIES = {"a38_bootstrap_ci": a38_bootstrap_ci, "a39_paired_bootstrap": paired, "a42_holm": a42_holm, "a44_sweep_summary": a44_sweep_summary}

_P = PRIME
_W = f"""WITH RECURSIVE r AS (SELECT DISTINCT * EXCLUDE (finished_at) FROM agentic_ablation), v AS (SELECT question_id, row_name, coalesce(exact_match::INT, 0)::DOUBLE AS em, coalesce(f1_score, 0) AS f1, coalesce(retrieval_recall, 0) AS sf_recall,
        CASE WHEN coalesce(retrieval_precision, 0) + coalesce(retrieval_recall, 0) > 0 THEN 2 * coalesce(retrieval_precision, 0) * coalesce(retrieval_recall, 0) / (coalesce(retrieval_precision, 0) + coalesce(retrieval_recall, 0)) ELSE 0 END AS sf_f1 FROM r WHERE question_id IS NOT NULL),
    hq AS (SELECT DISTINCT question_id, ('0x' || substring(md5(question_id), 1, 8))::BIGINT % {_P} AS h, ('0x' || substring(md5(question_id), 9, 8))::BIGINT % {_P} AS g FROM v),
    x0 AS (SELECT question_id, b, g, (h + b) % {_P} * ((g + 48271 * b) % {_P}) % {_P} AS x FROM hq, range(1, {RESAMPLES} + 1) t(b)), x1 AS (SELECT question_id, b, (x * ((x + g) % {_P}) % {_P}) / {float(_P)}::DOUBLE AS u FROM x0),
    w AS (SELECT question_id, b, {' + '.join(f'(u >= {p})::INT' for p in POISSON)} AS w FROM x1), m AS (UNPIVOT v ON em, f1, sf_f1, sf_recall INTO NAME metric VALUE x),
    sm AS (SELECT metric, row_name, b, sum(w * x) / sum(w) AS m FROM m JOIN w USING (question_id) GROUP BY 1, 2, 3 HAVING sum(w) > 0), si AS (SELECT metric, row_name, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high FROM sm GROUP BY 1, 2),
    sp AS (SELECT metric, row_name, count(*) AS n, round(avg(x), 9) AS mean FROM m GROUP BY 1, 2), s AS (SELECT * FROM sp JOIN si USING (metric, row_name))"""


def _pair_sql(pairs: list[tuple[str, str]]) -> str:
    return f""", o(row_a, row_b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in pairs)}), d AS (SELECT a.metric, row_a, row_b, a.question_id, b.x - a.x AS d FROM o JOIN m a ON a.row_name = row_a JOIN m b ON b.row_name = row_b AND b.metric = a.metric AND b.question_id = a.question_id),
    pt AS (SELECT metric, row_a, row_b, avg(d) AS delta, count(*) AS n FROM d GROUP BY 1, 2, 3), dm AS (SELECT metric, row_a, row_b, b, sum(w * d) / sum(w) AS m FROM d JOIN w USING (question_id) GROUP BY 1, 2, 3, 4 HAVING sum(w) > 0),
    g AS (SELECT metric, row_a, row_b, any_value(n) AS n, round(any_value(delta), 6) AS delta, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high, round((count(*) FILTER (round(abs(m - delta), 9) >= round(abs(delta), 9)) + 1) / {RESAMPLES + 1}, 6) AS p_value FROM dm JOIN pt USING (metric, row_a, row_b) GROUP BY 1, 2, 3)"""


ORACLE = {
    "a38_bootstrap_ci": _W + " SELECT * FROM s",
    "a39_paired_bootstrap": _W + _pair_sql(ADJACENT) + " SELECT * FROM g",
    "a42_holm": _W + _pair_sql(ADJACENT) + ", h AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p_value, row_a) AS holm_rank, count(*) OVER (PARTITION BY metric) AS k FROM g), q AS (SELECT *, round(max(least(1, (k - holm_rank + 1) * p_value)) OVER (PARTITION BY metric ORDER BY holm_rank), 6) AS p_adjusted FROM h) SELECT * EXCLUDE (k), p_adjusted <= 0.05 AS significant FROM q",
    "a44_sweep_summary": _W + _pair_sql([(ROWS[0], r) for r in ROWS[1:]]) + f""" SELECT s.metric, s.row_name, s.n, s.mean AS point, s.ci_low, s.ci_high, g.delta, g.ci_low AS delta_ci_low, g.ci_high AS delta_ci_high, g.p_value, s.row_name = '{ROWS[0]}' AS is_baseline, g.ci_low > 0 OR g.ci_high < 0 AS significant
        FROM s LEFT JOIN g ON g.metric = s.metric AND g.row_b = s.row_name""",
}
