"""Problem 6: the k most similar vectors for every vector, by collision-counting hashing.

Directions are laid out several times; a layout is a random-projection tree whose split points come from a bounded
sample down to MAX_DEPTH levels, and from all rows of a branch below them. So its cells have about CELL rows at any input
size, every row is indexed in every layout, and the number of layouts follows the whole depth. Layouts are searched
AT_ONCE at a time, each lot leaving only the k best others of every row, so that disk holds one lot's rows. In a cell, M
random single projections are kept as sorted arrays. A query-centred window in each array is widened in rounds (virtual
rehashing); each other vector inside a window is a collision, and vectors that reach the collision threshold are
verified by their exact cosine. Exact copies are represented once, so a large group of them fills no cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.operators.skew import attach_counted
from lanefold.sources.shared import load, materialise

K = 5
CELL = 1024
#: levels whose cuts come from the sample; a branch below them is worked on by one task, which halves it further
MAX_DEPTH = 12
SAMPLE_ROWS = 65_536
AT_ONCE = 10
M = 32
THRESHOLD = 7
WINDOWS = (64, 32, 16)
#: pairs at this cosine are met in some layout with probability RECALL
AIM_COSINE, RECALL, MIN_LAYOUTS = 0.87, 0.97, 10


def n_layouts(depth: int) -> int:
    """Layouts needed so that a pair at AIM_COSINE shares a cell in at least one with probability RECALL."""
    together = (1 - math.acos(AIM_COSINE) / math.pi) ** depth
    return max(MIN_LAYOUTS, math.ceil(math.log(1 - RECALL) / math.log(1 - together)) if together < 1 else 1)


def fit_trees(sample: np.ndarray, depth: int, layouts: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(directions: dim x layouts*depth, cuts: layouts x 2^depth) of the projection trees; cuts are medians of the sample."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((sample.shape[1], max(1, layouts * depth))).astype(np.float32)
    cuts = np.zeros((layouts, 1 << depth), np.float32)
    for t in range(layouts):
        node = np.ones(len(sample), np.int64)
        for level in range(depth):
            p = sample @ directions[:, t * depth + level]
            order = np.lexsort((p, node))
            first = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
            some = np.flatnonzero(first[1:] > first[:-1])
            cuts[t, (1 << level) + some] = p[order[(first[some] + first[some + 1] - 1) // 2]]
            node = 2 * node + (p > cuts[t, node])
    return directions, cuts


def cells_of(x: np.ndarray, directions: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """rows x layouts leaf numbers."""
    p = x @ directions
    out = np.ones((len(x), len(cuts)), np.int64)
    for t in range(len(cuts)):
        for level in range(depth):
            out[:, t] = 2 * out[:, t] + (p[:, t * depth + level] > cuts[t, out[:, t]])
    return out


def halved(x: np.ndarray, layout: int, levels: int) -> list[np.ndarray]:
    """The row numbers of the 2^levels cells of one branch of a layout, halved at the median of one projection a level."""
    p = x @ np.random.default_rng([13, layout]).standard_normal((x.shape[1], levels)).astype(np.float32)
    parts = [np.arange(len(x))]
    for level in range(levels):
        ordered = [at[np.argsort(p[at, level], kind="stable")] for at in parts]
        parts = [half for at in ordered for half in np.split(at, [len(at) // 2])]
    return parts


def collide(x: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, cosine): up to k best verified others of each row of one cell; rows of x are unit vectors."""
    s = len(x)
    rng = np.random.default_rng(seed)
    orders = np.argsort(x @ rng.standard_normal((x.shape[1], M)).astype(np.float32), axis=0).T
    hits = np.zeros((s, s), np.uint8)
    flat = hits.ravel()
    done = 0
    seen = np.zeros((s, s), bool)
    qs, os, cs = [], [], []
    for w in WINDOWS:
        reach = min(s - 1, max(4, s // w))
        for order in orders:
            line = order * s
            for t in range(done + 1, reach + 1):
                flat[line[:-t] + order[t:]] += 1
        done = max(done, reach)
        met = hits + hits.T
        fresh = (met >= (THRESHOLD if s > 64 else 1)) & ~seen
        seen |= fresh
        a, b = np.nonzero(np.triu(fresh, 1))
        for lo in range(0, len(a), 200_000):
            i, j = a[lo : lo + 200_000], b[lo : lo + 200_000]
            cos = np.einsum("ij,ij->i", x[i], x[j])
            qs += [i, j]
            os += [j, i]
            cs += [cos, cos]
    if not qs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    q, o, c = np.concatenate(qs), np.concatenate(os), np.concatenate(cs)
    best = np.lexsort((o, -c, q))
    q, o, c = q[best], o[best], c[best]
    _, start, n = np.unique(q, return_index=True, return_counts=True)
    keep = np.arange(len(q)) - np.repeat(start, n) < k
    return q[keep], o[keep], c[keep]


def _unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        x = np.stack([np.asarray(v, np.float64) for v in batch["v"]])
        norm = np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(1, keepdims=True)
        x = (x / norm).astype(np.float32)
        same = (np.round(x, 5) + 0.0).astype(np.float32)
        yield pd.DataFrame({"id": batch["id"], "unit": [r.tobytes() for r in x], "same": [r.tobytes() for r in same]})


def usable(v: Column, dim: int) -> Column:
    """Whether an embedding has dim values, all finite and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = K) -> DataFrame:
    """(id, other, cosine): the k most similar others of every row with a usable embedding, ids as strings.

    Rows whose embedding is null, not of dim values, not finite or all zero take no part, nor do null ids. Repeated ids
    count once (where their embeddings differ, the greatest one holds). Vectors equal to five decimals after
    normalisation are copies: among equally similar others the smaller id comes first, so each member of a large group
    of copies gets the group's first ids. Fewer than k others give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    raw = raw.where(F.col("id").isNotNull() & usable(F.col("v"), dim)).groupBy("id").agg(F.max("v").alias("v"))
    units = raw.mapInPandas(_unit, "id string, unit binary, same binary").withColumn("same", F.sha2("same", 256))
    units = materialise(units, "units")
    # the first k+1 ids of each group of copies stand for it; the window keeps k+1 rows of a group before the shuffle
    first = Window.partitionBy("same").orderBy("id")
    heads = materialise(units.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1), "heads")
    reps = heads.where(F.col("place") == 1).select(F.col("id").alias("rep"), "unit")
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], "id string, other string, cosine double")
    whole = max(0, math.ceil(math.log2(n / CELL)))
    depth = min(MAX_DEPTH, whole)
    layouts = n_layouts(whole) if whole else 1
    every = max(1, n // SAMPLE_ROWS)
    sampled = reps.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("unit").limit(2 * SAMPLE_ROWS).toPandas()["unit"]
    sample = np.frombuffer(b"".join(sampled), np.float32).reshape(-1, dim)
    directions, cuts = fit_trees(sample, depth, layouts)
    ranked = Window.partitionBy("rep").orderBy(F.desc("cosine"), "near")
    best = lambda met: met.groupBy("rep", "near").agg(F.max("cosine").alias("cosine")).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).select("rep", "near", "cosine")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        if whole == depth:
            x = np.frombuffer(b"".join(group["unit"]), np.float32).reshape(-1, dim)
            parts = [np.arange(len(x))]
        else:
            group = group.sort_values("rep")
            x = np.frombuffer(b"".join(group["unit"]), np.float32).reshape(-1, dim)
            parts = [at for at in halved(x, int(group["layout"].iloc[0]), whole - depth) if len(at) > 1]
        rep = group["rep"].to_numpy()
        out = [pd.DataFrame({"rep": [], "near": [], "cosine": []})]
        for at in parts:
            q, o, c = collide(x[at], k)
            out.append(pd.DataFrame({"rep": rep[at[q]], "near": rep[at[o]], "cosine": c.astype(float)}))
        return pd.concat(out[1:] or out)

    def lot(first: int, last: int) -> DataFrame:
        """The k best others of every row within layouts first to last - 1."""
        used, own = directions[:, first * depth : last * depth], cuts[first:last]

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = np.frombuffer(b"".join(batch["unit"]), np.float32).reshape(-1, dim)
                cell = cells_of(x, used, own, depth) if depth else np.ones((len(x), 1), np.int64)
                for t in range(last - first):
                    yield pd.DataFrame({"layout": first + t, "cell": cell[:, t], "rep": batch["rep"], "unit": batch["unit"]})

        placed = reps.mapInPandas(place, "layout int, cell long, rep string, unit binary")
        return best(placed.groupBy("layout", "cell").applyInPandas(search, "rep string, near string, cosine double"))

    met = None
    for first in range(0, layouts, AT_ONCE):
        part = materialise(lot(first, min(layouts, first + AT_ONCE)), "near")
        met = part if met is None else met.unionByName(part)
        spark.sparkContext._jvm.System.gc()  # lets the shuffle files of the lot be removed
    pairs = best(met)
    listed = heads.groupBy("same").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))  # k+1 ids at most
    others = pairs.join(listed.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "ids", "cosine")
    own = listed.where(F.size("ids") > 1).select("rep", "ids", F.lit(1.0).alias("cosine"))
    options = own.unionByName(others).groupBy("rep").agg(F.collect_list(F.struct("cosine", "ids")).alias("o"))  # k+1 lists
    options = options.join(listed.select("rep", "same"), "rep").select("same", "o")
    expanded = attach_counted(units.select("id", "same"), options, "same").select("id", F.explode("o").alias("o"))
    expanded = expanded.select("id", "o.cosine", F.explode("o.ids").alias("other")).where(F.col("other") != F.col("id"))
    final = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    top = expanded.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k)
    return top.select("id", "other", F.round("cosine", 6).alias("cosine"))


def similar_pairs(near: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of pairs where at least one is among the other's nearest."""
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(nearest(load(spark, sf_dir, "chunk_vectors"), "chunk_id", "embedding"))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of each row of the embeddings table."""
    return nearest(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES = {"p6_found": p6_found, "p6_embeddings": p6_embeddings}
ORACLE: dict[str, str] = {}
