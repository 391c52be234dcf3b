"""Problem 3: items that appear together, by a blocked Gram matrix.

Baskets become a binary records x items matrix, cut into record blocks (the rows of one task). In a block the items are
ordered by frequency; products of the frequent ones are dense 0/1 matrix products, all others sparse outer products
summed by item pair. A block so emits one count per item pair it holds, whatever the number of its records, and only
these partial sums are shuffled. A basket too large for one task is cut into item blocks, and each pair of its item
blocks becomes a basket of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators.skew import attach
from lanefold.sources.shared import load, materialise

ITEM_BLOCK = 512
RECORD_BLOCK = 16_384
PAIRS_AT_ONCE = 2_000_000


def gram(rows: np.ndarray, cols: np.ndarray, n_items: int, dense: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count) of the off-diagonal upper triangle of X'X; X has a 1 at each distinct (rows, cols).

    The ``dense`` most frequent columns are multiplied as a dense block, the rest as sparse outer products.
    """
    freq = np.bincount(cols, minlength=n_items)
    place = np.empty(n_items, np.int64)
    place[np.argsort(-freq, kind="stable")] = np.arange(n_items)
    cols = place[cols]
    back = np.argsort(place)
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    _, start, size = np.unique(rows, return_index=True, return_counts=True)
    end = np.repeat(start + size, size)
    head = cols < dense
    width = min(dense, n_items)
    acc: dict[str, np.ndarray] = {"k": np.empty(0, np.int64), "c": np.empty(0, np.int64)}
    if head.any():
        ids, local = np.unique(rows[head], return_inverse=True)
        product = np.zeros((width, width))
        for lo in range(0, len(ids), RECORD_BLOCK):
            part = (local >= lo) & (local < lo + RECORD_BLOCK)
            block = np.zeros((min(RECORD_BLOCK, len(ids) - lo), width), np.float32)
            block[local[part] - lo, cols[head][part]] = 1
            product += block.T @ block
        a, b = np.nonzero(np.triu(product, 1))
        acc = {"k": a * n_items + b, "c": product[a, b].astype(np.int64)}
    # a row's pairs (i, j), i before j, are i's later neighbours; pairs of two dense columns are done
    later = end - np.arange(len(rows)) - 1
    upto = np.cumsum(later)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        n = later[lo:hi]
        left = np.repeat(np.arange(lo, hi), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        a, b = cols[left], cols[right]
        keep = b >= dense
        k, c = np.unique(a[keep] * n_items + b[keep], return_counts=True)
        key, inverse = np.unique(np.concatenate([acc["k"], k]), return_inverse=True)
        acc = {"k": key, "c": np.bincount(inverse, np.concatenate([acc["c"], c]), len(key)).astype(np.int64)}
        lo = hi
    return back[acc["k"] // n_items], back[acc["k"] % n_items], acc["c"]


def _gram_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One record block per run of batches of bounded size; basket rows are whole (basket, items, counts)."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        block = pd.concat(held)
        size = block["items"].map(len).to_numpy()
        rows = np.repeat(np.arange(len(block)), size)
        names = np.concatenate(block["items"].to_list())
        n = np.concatenate(block["counts"].to_list())
        kinds = np.repeat(block["item_kind"].to_numpy(), size)
        tag = np.repeat(block["part"].to_numpy(), size)
        side = np.concatenate(block["sides"].to_list())
        codes, items = pd.factorize(pd.MultiIndex.from_arrays([kinds, names]))
        counts = np.zeros(len(items), np.int64)
        counts[codes] = n
        out = []
        plain = tag == 0
        if plain.any():
            out.append(gram(rows[plain], codes[plain], len(items)))
        cut = ~plain
        if cut.any():  # of a basket made of two different item blocks only the pairs across count
            for r in np.unique(rows[cut]):
                at = np.flatnonzero(rows == r)
                i, j = codes[at[side[at] == 0]], codes[at[side[at] == 1]]
                for x in i:
                    out.append((np.full(len(j), x), j, np.ones(len(j), np.int64)))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        name, kind = items.get_level_values(1).to_numpy(), items.get_level_values(0).to_numpy()
        swap = name[a] > name[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"item_kind": kind[a], "item_a": name[a], "item_b": name[b], "count_a": counts[a], "count_b": counts[b], "together": c})

    held, n = [], 0
    for batch in batches:
        batch = batch[batch["items"].map(len) > 1]
        if len(batch):
            held.append(batch)
            n += int(batch["items"].map(len).sum())
        if n >= 16 * RECORD_BLOCK:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def baskets(chunks: DataFrame) -> DataFrame:
    """Distinct (item_kind, chunk_id, item) of the entities and relation types of each chunk; nulls are no items."""
    chunk = chunks.select("chunk_id", F.col("entities.entity_id").alias("e"), F.col("relations.relation_type").alias("r"))
    pairs = F.concat(
        F.transform(F.coalesce("e", F.array().cast("array<string>")), lambda x: F.struct(F.lit("entity").alias("item_kind"), x.alias("item"))),
        F.transform(F.coalesce("r", F.array().cast("array<string>")), lambda x: F.struct(F.lit("relation").alias("item_kind"), x.alias("item"))),
    )
    return chunk.where(F.col("chunk_id").isNotNull()).select("chunk_id", F.inline(pairs)).where(F.col("item").isNotNull()).distinct()


def cooccurrence(chunks: DataFrame, min_together: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """item_kind, item_a, item_b, together, count_a, count_b, n_chunks, ratio for item_a < item_b of the same kind.

    together and the counts are numbers of distinct chunk_id, n_chunks is that of all chunk_id, ratio =
    together * n_chunks / (count_a * count_b). An item in fewer than min_together chunks can be in no result pair and is
    left out before pairing, as is one in more than n_chunks / min_ratio chunks. Null chunk_id, lists and items are
    ignored; an empty string is an item; an empty table gives no rows.
    """
    items = materialise(baskets(chunks), "baskets")
    n_chunks = chunks.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct().count()
    key = F.concat_ws("\u0001", "item_kind", "item")
    counts = items.groupBy(key.alias("_item")).agg(F.count(F.lit(1)).alias("_count"))
    total = items.count()
    alive = counts.where((F.col("_count") >= min_together) & (F.col("_count") * F.lit(min_ratio) <= F.lit(n_chunks)))
    kept = attach(items.withColumn("_item", key), alive, "_item", "_count", total)
    # a basket beyond two item blocks is cut into item blocks; each pair of blocks is a basket of its own
    sizes = kept.groupBy("item_kind", "chunk_id").agg(F.count(F.lit(1)).alias("_size"))
    big = sizes.where(F.col("_size") > 2 * ITEM_BLOCK).select("item_kind", "chunk_id", F.ceil(F.col("_size") / ITEM_BLOCK).cast("int").alias("_blocks"))
    marked = kept.join(big, ["item_kind", "chunk_id"], "left")
    block = F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int")
    whole = marked.where(F.col("_blocks").isNull()).select(
        "item_kind", "chunk_id", "item", "_count", F.lit(0).alias("part"), F.lit(0).alias("sub"), F.lit(0).alias("side")
    )
    cut = marked.where(F.col("_blocks").isNotNull()).withColumn("_b", block)
    cut = cut.select(
        "item_kind", "chunk_id", "item", "_count",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(
            F.when(o == F.col("_b"), 0).otherwise(1).alias("part"),
            (F.least(o, F.col("_b")) * F.col("_blocks") + F.greatest(o, F.col("_b"))).alias("sub"),
            F.when(o > F.col("_b"), 0).when(o < F.col("_b"), 1).otherwise(0).alias("side"),
        ))).alias("x"),
    ).select("item_kind", "chunk_id", "item", "_count", "x.*")
    rows = (
        whole.unionByName(cut)
        .groupBy("item_kind", "chunk_id", "part", "sub")
        .agg(F.collect_list(F.struct("item", "_count", "side")).alias("x"))
        .select("item_kind", "part", F.col("x.item").alias("items"), F.col("x._count").alias("counts"), F.col("x.side").alias("sides"))
    )
    schema = "item_kind string, item_a string, item_b string, count_a long, count_b long, together long"
    partial = rows.mapInPandas(_gram_block, schema)
    summed = partial.groupBy("item_kind", "item_a", "item_b").agg(
        F.sum("together").alias("together"), F.first("count_a").alias("count_a"), F.first("count_b").alias("count_b")
    )
    n = F.lit(n_chunks).cast("long")
    return summed.where(
        (F.col("together") >= min_together) & (F.col("together").cast("double") * n >= F.lit(float(min_ratio)) * F.col("count_a") * F.col("count_b"))
    ).withColumn("n_chunks", n).withColumn("ratio", F.col("together").cast("double") * n / (F.col("count_a").cast("double") * F.col("count_b")))


def p3_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(load(spark, sf_dir, "chunk_extractions")).withColumn("ratio", F.round("ratio", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(load(spark, sf_dir, "chunk_extractions"), 5, 3.0).select("item_kind", "item_a", "item_b")


QUERIES = {"p3_cooccurrence": p3_cooccurrence, "p3_found": p3_found}

_PAIRS = """
    WITH b AS (
        SELECT DISTINCT 'entity' AS item_kind, chunk_id, e.entity_id AS item
        FROM (SELECT chunk_id, unnest(entities) AS e FROM chunk_extractions) WHERE e.entity_id IS NOT NULL AND chunk_id IS NOT NULL
        UNION
        SELECT DISTINCT 'relation', chunk_id, r.relation_type
        FROM (SELECT chunk_id, unnest(relations) AS r FROM chunk_extractions) WHERE r.relation_type IS NOT NULL AND chunk_id IS NOT NULL
    ), c AS (SELECT item_kind, item, count(*) AS n FROM b GROUP BY 1, 2),
    n AS (SELECT count(DISTINCT chunk_id) AS n_chunks FROM chunk_extractions),
    p AS (
        SELECT x.item_kind, x.item AS item_a, y.item AS item_b, count(*) AS together
        FROM b x JOIN b y ON x.item_kind = y.item_kind AND x.chunk_id = y.chunk_id AND x.item < y.item GROUP BY 1, 2, 3
    ), r AS (
        SELECT p.*, ca.n AS count_a, cb.n AS count_b, n_chunks, together * n_chunks / (ca.n * cb.n) AS ratio
        FROM p JOIN c ca ON ca.item_kind = p.item_kind AND ca.item = item_a
        JOIN c cb ON cb.item_kind = p.item_kind AND cb.item = item_b, n
    )"""

ORACLE = {
    "p3_cooccurrence": _PAIRS + " SELECT item_kind, item_a, item_b, together, count_a, count_b, n_chunks, round(ratio, 6) AS ratio FROM r",
    "p3_found": _PAIRS + " SELECT item_kind, item_a, item_b FROM r WHERE together >= 5 AND together * n_chunks >= 3 * count_a * count_b",
}
