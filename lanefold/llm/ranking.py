"""Problem 7: one ranking from several differently scaled scores, by ideal-point ranking.

Per query and score: winsorise at the outer fences (quartiles -/+ 3 interquartile ranges), measure from the lowest
winsorised value, divide by the Euclidean norm of the query's values, then take weighted Minkowski distances (exponent
0.25: one large gap costs less than gaps everywhere) to the ideal and the anti-ideal point. Closeness is
d_anti / (d_anti + d_ideal). A chunk that a lane did not return stands at that lane's anti-ideal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators.skew import attach, offset_chunks
from lanefold.sources.shared import load, materialise

SCORES = ("vector_score", "bm25_score", "graph_score", "rrf_score")
FENCE = 3.0
EXPONENT = 0.25
CHUNK_ROWS = 100_000


def scored(results: DataFrame, weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, stats): each distinct (query_id, chunk_id) with its four scores, n_best and closeness; one stats row per query.

    Repeated rows count once; where they disagree, the highest score holds. Rows without query_id or chunk_id are left
    out; NaN counts as null. A score whose values are all alike or all null moves nobody. Statistics are built from
    partial aggregates (quartiles to a rank error of 1/10000, exact up to 10000 rows), so no query is sent to one task.
    """
    weights = weights or {s: 1 / len(SCORES) for s in SCORES}
    clean = [F.max(F.when(~F.isnan(s), F.col(s))).alias(s) for s in SCORES]
    base = results.where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()).groupBy("query_id", "chunk_id").agg(*clean)
    base = materialise(base, "scores")
    total = base.count()
    stats = base.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(s, [0.25, 0.75], 10_000).alias(f"q_{s}") for s in SCORES],
        *[F.max(s).alias(f"max_{s}") for s in SCORES],
        *[F.min(s).alias(f"min_{s}") for s in SCORES],
        *[F.count(s).alias(f"n_{s}") for s in SCORES],
    )
    for s in SCORES:
        q = F.col(f"q_{s}")
        spread = (q[1] - q[0]) * FENCE
        stats = stats.withColumn(f"lo_{s}", F.greatest(F.col(f"min_{s}"), q[0] - spread)).withColumn(f"hi_{s}", F.least(F.col(f"max_{s}"), q[1] + spread)).drop(f"q_{s}")
    stats = materialise(stats, "score-stats")
    rows = attach(base, stats, "query_id", "n", total)
    for s in SCORES:
        lo = F.col(f"lo_{s}")
        rows = rows.withColumn(f"w_{s}", F.coalesce(F.least(F.greatest(F.col(s), lo), F.col(f"hi_{s}")) - lo, F.lit(0.0)))
    norms = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sqrt(F.sum(F.col(f"w_{s}") ** 2)).alias(f"norm_{s}") for s in SCORES], *[F.max(f"w_{s}").alias(f"top_{s}") for s in SCORES]
    )
    rows = attach(rows.drop("n"), norms, "query_id", "n", total)
    ideal, anti, best = F.lit(0.0), F.lit(0.0), F.lit(0)
    for s in SCORES:
        w, norm = F.lit(weights[s]), F.when(F.col(f"norm_{s}") > 0, F.col(f"norm_{s}")).otherwise(F.lit(1.0))
        ideal = ideal + w * F.pow((F.col(f"top_{s}") - F.col(f"w_{s}")) / norm, F.lit(EXPONENT))
        anti = anti + w * F.pow(F.col(f"w_{s}") / norm, F.lit(EXPONENT))
        best = best + F.when(F.col(s) == F.col(f"max_{s}"), 1).otherwise(0)
    d_ideal, d_anti = F.pow(ideal, F.lit(1 / EXPONENT)), F.pow(anti, F.lit(1 / EXPONENT))
    closeness = F.when(d_ideal + d_anti > 0, d_anti / (d_ideal + d_anti)).otherwise(F.lit(0.0))
    rows = rows.select("query_id", "chunk_id", *SCORES, best.alias("n_best"), F.round(closeness, 9).alias("closeness"))
    return rows, stats


def ranking(results: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, chunk_id, closeness, rank (1-based): by closeness, then number of scores led, then chunk_id.

    Rows are range-partitioned by query and position and numbered by exact offsets, so a query of any size is spread.
    """
    rows, _ = scored(results)
    order = rows.withColumn("_c", -F.col("closeness")).withColumn("_b", -F.col("n_best"))
    placed = offset_chunks(order.repartitionByRange("query_id", "_c", "_b", "chunk_id"), ["query_id"], chunk_rows, ["_c", "_b", "chunk_id"])
    firsts = placed.groupBy("query_id").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"))
    total = placed.count()
    return attach(placed, firsts, "query_id", "n", total).select(
        "query_id", "chunk_id", "closeness", (F.col("_row") - F.col("_first") + 1).cast("long").alias("rank")
    )


def leaders(results: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the first-ranked chunk of the queries that one chunk leads clearly.

    Such a query has a chunk that is strictly highest in at least three scores and, in the remaining one if any, not
    null and not below the median of the query's values. Counting places the median: a value is not below it where more
    than half of the values are at most as high.
    """
    rows, stats = scored(results)
    rows = materialise(rows, "closeness")
    first = rows.groupBy("query_id").agg(F.max_by("chunk_id", F.struct("closeness", "n_best", F.unhex(F.translate(F.hex("chunk_id"), "0123456789ABCDEF", "FEDCBA9876543210")))).alias("chunk_id"))
    full = attach(rows, stats, "query_id", "n", rows.count())
    top = [(F.col(s) == F.col(f"max_{s}")) for s in SCORES]
    marked = full.select("query_id", "chunk_id", *SCORES, *[F.when(t, 1).alias(f"t_{s}") for s, t in zip(SCORES, top)])
    ties = marked.groupBy("query_id").agg(*[F.count(f"t_{s}").alias(f"ties_{s}") for s in SCORES], F.count(F.lit(1)).alias("n"))
    lone = attach(marked, ties, "query_id", "n", rows.count())
    wins = sum(F.when((F.col(f"t_{s}") == 1) & (F.col(f"ties_{s}") == 1), 1).otherwise(0) for s in SCORES)
    lead = lone.withColumn("wins", wins).where((F.col("wins") >= 3) & F.expr(" and ".join(f"{s} is not null" for s in SCORES)))
    lead = lead.select("query_id", *[F.col(s).alias(f"x_{s}") for s in SCORES])  # at most one a query
    counted = attach(rows, stats.select("query_id", "n", *[f"n_{s}" for s in SCORES]), "query_id", "n", rows.count())
    sized = attach(counted.drop("n"), lead.join(stats.select("query_id", "n"), "query_id"), "query_id", "n", rows.count())
    at_most = sized.groupBy("query_id").agg(
        *[F.count(F.when(F.col(s) <= F.col(f"x_{s}"), 1)).alias(f"le_{s}") for s in SCORES], *[F.first(f"n_{s}").alias(f"n_{s}") for s in SCORES]
    )
    good = at_most.where(F.expr(" and ".join(f"le_{s} >= floor(n_{s} / 2) + 1" for s in SCORES))).select("query_id")
    return first.join(good, "query_id").select("query_id", "chunk_id")


def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking(load(spark, sf_dir, "retrieval_results"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaders(load(spark, sf_dir, "retrieval_results"))


QUERIES = {"p7_ranking": p7_ranking, "p7_found": p7_found}

_LEAD = """
    WITH b AS (
        SELECT query_id, chunk_id, max(vector_score) AS v, max(bm25_score) AS t, max(graph_score) AS g, max(rrf_score) AS r
        FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2
    ), u AS (SELECT query_id, chunk_id, lane, x FROM b UNPIVOT INCLUDE NULLS (x FOR lane IN (v, t, g, r))),
    s AS (SELECT query_id, lane, max(x) AS top, median(x) AS mid FROM u GROUP BY 1, 2),
    k AS (SELECT u.query_id, lane, count(*) AS ties FROM u JOIN s USING (query_id, lane) WHERE x = top GROUP BY 1, 2),
    w AS (
        SELECT u.query_id, chunk_id, count(*) FILTER (x = top AND ties = 1) AS wins, bool_and(coalesce(x >= mid, FALSE)) AS fair
        FROM u JOIN s USING (query_id, lane) JOIN k USING (query_id, lane) GROUP BY 1, 2
    )"""

_CLOSE = """
    WITH b AS (
        SELECT query_id, chunk_id, max(vector_score) AS v, max(bm25_score) AS t, max(graph_score) AS g, max(rrf_score) AS r
        FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2
    ), u AS (SELECT query_id, chunk_id, lane, x FROM b UNPIVOT INCLUDE NULLS (x FOR lane IN (v, t, g, r))),
    o AS (SELECT query_id, lane, list(x ORDER BY x) FILTER (x IS NOT NULL) AS xs FROM u GROUP BY 1, 2),
    q AS (SELECT query_id, lane, xs[1] AS low, xs[-1] AS most, xs[ceil(0.25 * len(xs))::INT] AS q1, xs[ceil(0.75 * len(xs))::INT] AS q3 FROM o),
    f AS (SELECT query_id, lane, most, greatest(low, q1 - 3 * (q3 - q1)) AS lo, least(most, q3 + 3 * (q3 - q1)) AS hi FROM q),
    w AS (SELECT query_id, chunk_id, lane, coalesce(least(greatest(x, lo), hi) - lo, 0) AS w, (x = most)::INT AS best FROM u JOIN f USING (query_id, lane)),
    n AS (SELECT query_id, lane, sqrt(sum(w * w)) AS norm, max(w) AS top FROM w GROUP BY 1, 2),
    d AS (SELECT query_id, chunk_id, sum(0.25::DOUBLE * pow((top - w) / CASE WHEN norm > 0 THEN norm ELSE 1 END, 0.25)) AS di, sum(0.25::DOUBLE * pow(w / CASE WHEN norm > 0 THEN norm ELSE 1 END, 0.25)) AS da, sum(coalesce(best, 0)) AS n_best FROM w JOIN n USING (query_id, lane) GROUP BY 1, 2),
    c AS (SELECT query_id, chunk_id, n_best, round(CASE WHEN pow(di, 4) + pow(da, 4) > 0 THEN pow(da, 4) / (pow(di, 4) + pow(da, 4)) ELSE 0 END, 9) AS closeness FROM d)"""

ORACLE = {
    "p7_found": _LEAD + " SELECT query_id, chunk_id FROM w WHERE wins >= 3 AND fair",
    "p7_ranking": _CLOSE + " SELECT query_id, chunk_id, closeness, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, n_best DESC, chunk_id) AS rank FROM c",
}
