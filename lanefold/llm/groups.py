"""Problem 5: pairwise matches consolidated into groups, by low-diameter decomposition.

Each round draws an exponential shift for every vertex; clusters grow from the vertices with the largest shifts, one hop
a step, and a vertex belongs to the cluster that reaches it at the least (hops - shift of the centre). Clusters are then
contracted to super-vertices and the edges between clusters are the next round's graph. A round leaves a constant
fraction of the edges, so rounds are logarithmic in the edges whatever the diameter; any cluster is connected, so the
result is exact. Assignments of all rounds are composed at the end, from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators.skew import attach
from lanefold.sources.shared import load, materialise

BETA = 0.2
STEPS = 5
PART_EDGES = 20_000


def _shift(vertex: F.Column, seed: int) -> F.Column:
    """Exponential of mean 1/BETA from a hash of the vertex."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    return -F.log(u) / F.lit(BETA)


def _graph(pairs: DataFrame) -> tuple[DataFrame, int, bool]:
    """(edges both ways and self-loops of cost 0, number of edges, whether an end has more than one part).

    Columns a, b, cost, salt, parts. The loops let one aggregation move both the messages of neighbours and a vertex's own
    state. A vertex has one part per PART_EDGES of its edges, and an edge of such a vertex the salt of one of them; there
    are at most edges / PART_EDGES of these vertices, so the join that marks them is small on one side.
    """
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    sided = pairs.select(F.explode(both).alias("e")).select("e.*")
    degrees = sided.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_EDGES).cast("int").alias("parts"))
    marked = sided.join(degrees.where("parts > 1"), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    edges = marked.select("a", "b", F.lit(1).alias("cost"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"), "parts")
    loops = degrees.select("a", F.col("a").alias("b"), F.lit(0).alias("cost"), F.lit(0).alias("salt"), "parts")
    table = materialise(edges.unionByName(loops), "graph")
    n = table.agg(F.count(F.when(F.col("cost") == 1, 1)).alias("edges"), F.coalesce(F.max("parts"), F.lit(1)).alias("parts")).first()
    return table, n["edges"], n["parts"] > 1


def _sent(edges: DataFrame, state: DataFrame, heavy: bool) -> DataFrame:
    """The state of each edge's first end at the edge. Ends of one part meet on the vertex alone, by which the state is
    already partitioned; those of several parts on vertex and salt, with one copy of the state a part."""
    light = edges.where("parts = 1").select("a", "b", "cost").join(state.drop("parts").withColumnRenamed("v", "a"), "a")
    if not heavy:
        return light
    copies = state.where("parts > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).drop("parts").withColumnRenamed("v", "a")
    return light.unionByName(edges.where("parts > 1").select("a", "b", "cost", "salt").join(copies, ["a", "salt"]).drop("salt"))


def connected_groups(links: DataFrame, a: str, b: str, steps: int = STEPS) -> DataFrame:
    """(id, group_id) for every id that a link joins to another one; group_id is the smallest id of the group.

    Links are undirected; either order, repeats and any third column do not matter. Links with a null side and self
    links are ignored, so an id that stands only in these has no row. An empty table gives no rows.
    """
    pair = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    pairs = pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, n_edges, heavy = _graph(pairs)
    levels: list[DataFrame] = []
    while n_edges:
        own = edges.where("cost = 0").select(F.col("a").alias("v"), F.col("a").alias("centre"), "parts")
        state = own.select("v", "centre", (-_shift(F.col("v"), len(levels))).alias("key"), "parts")
        for _ in range(steps):
            best = F.min(F.struct((F.col("key") + F.col("cost")).alias("key"), "centre")).alias("m")
            kept = own.select("v", "parts") if heavy else None
            state = _sent(edges, state, heavy).groupBy(F.col("b").alias("v")).agg(best).select("v", "m.centre", "m.key")
            state = state.join(kept, "v") if heavy else state.withColumn("parts", F.lit(1))
        # a centre may itself have been taken over by another cluster: its followers are still connected through it
        assign = materialise(state.select("v", "centre", "parts"), "assigned")
        levels.append(assign)
        ends = _sent(edges.where("cost = 1"), assign, heavy)
        cut = ends.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("centre").alias("a"), F.max("centre").alias("b"))
        edges, n_edges, heavy = _graph(cut.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    # from the last round to the first, each vertex takes over what its centre has become
    final = None
    for assign in reversed(levels):
        here = assign.select(F.col("v").alias("id"), "centre")
        if final is not None:
            sizes = here.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
            known = sizes.join(final.select(F.col("id").alias("centre"), "top"), "centre")
            moved = attach(here, materialise(known, "moved"), "centre", "n", assign.count(), "left")
            here = moved.select("id", F.coalesce("top", "centre").alias("centre"))
        final = here.select("id", F.col("centre").alias("top"))
    if final is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    final = materialise(final, "tops")
    sizes = materialise(final.groupBy("top").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")), "groups")
    return attach(final, sizes, "top", "n", final.count()).select("id", "group_id")


def entity_groups(matches: DataFrame) -> DataFrame:
    """(entity_id, group_id) over entity_matches; see connected_groups."""
    return connected_groups(matches, "entity_id_a", "entity_id_b").withColumnRenamed("id", "entity_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_groups(load(spark, sf_dir, "entity_matches"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matched entity of extracted_entities with its name and group."""
    names = load(spark, sf_dir, "extracted_entities").where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.min("name").alias("name"))
    return names.join(entity_groups(load(spark, sf_dir, "entity_matches")), "entity_id")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}

_GROUPS = """
    WITH RECURSIVE e AS (
        SELECT entity_id_a AS a, entity_id_b AS b FROM entity_matches WHERE entity_id_a <> entity_id_b
        UNION SELECT entity_id_b, entity_id_a FROM entity_matches WHERE entity_id_a <> entity_id_b
    ), reach AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
    g AS (SELECT id AS entity_id, min(other) AS group_id FROM reach GROUP BY id)"""

ORACLE = {
    "p5_found": _GROUPS + " SELECT entity_id, group_id FROM g",
    "p5_groups": _GROUPS + """
        SELECT g.entity_id, n.name, g.group_id
        FROM g JOIN (SELECT entity_id, min(name) AS name FROM extracted_entities GROUP BY 1) n ON n.entity_id = g.entity_id""",
}
