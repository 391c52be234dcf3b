"""Problem 4: per-entity results over mentions, where a few entity_id hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators.skew import chunked_agg, offset_chunks
from lanefold.sources.shared import load

CHUNK_ROWS = 50_000
HEAVY_SHARE = 0.02


def entity_profile(mentions: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """entity_id, n_chunks, first_linked_at, last_linked_at: one row per entity_id.

    Repeated (chunk_id, entity_id) rows count once, with all their times; rows whose entity_id is null are left out,
    a null chunk_id adds its times but no chunk, null times are ignored. An empty table gives no rows; other columns
    are not read.
    """
    edges = (
        mentions.select("entity_id", "chunk_id", "linked_at")
        .where(F.col("entity_id").isNotNull())
        .groupBy("entity_id", "chunk_id")
        .agg(F.min("linked_at").alias("lo"), F.max("linked_at").alias("hi"))
    )
    numbered = offset_chunks(edges, ["entity_id"], chunk_rows, ["chunk_id"])
    states = {"n": F.count("chunk_id"), "lo": F.min("lo"), "hi": F.max("hi")}
    merges = {"n_chunks": F.sum("n"), "first_linked_at": F.min("lo"), "last_linked_at": F.max("hi")}
    return chunked_agg(numbered, ["entity_id"], states, merges)


def heavy_entities(profile: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """The entity_id that hold at least ``share`` of all distinct (chunk_id, entity_id) rows: at most 1/share of them."""
    total = profile.agg(F.sum("n_chunks").alias("total"))
    return profile.crossJoin(F.broadcast(total)).where(F.col("n_chunks") >= F.lit(share) * F.col("total")).select("entity_id")


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_profile(load(spark, sf_dir, "mentions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_entities(entity_profile(load(spark, sf_dir, "mentions")))


QUERIES = {"p4_profile": p4_profile, "p4_found": p4_found}

ORACLE = {
    "p4_profile": """
        SELECT entity_id, count(DISTINCT chunk_id) AS n_chunks,
               min(linked_at) AS first_linked_at, max(linked_at) AS last_linked_at
        FROM mentions WHERE entity_id IS NOT NULL GROUP BY entity_id""",
    "p4_found": """
        WITH e AS (SELECT entity_id, count(DISTINCT chunk_id) AS n FROM mentions WHERE entity_id IS NOT NULL GROUP BY 1)
        SELECT entity_id FROM e WHERE n >= 0.02 * (SELECT sum(n) FROM e)""",
}
