"""Entity linking by vectors: deterministic hashed vectors, an exact similarity join of names, and merged groups per type."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.text import canonical_form
from lanefold.operators.graph import _G, entities
from lanefold.sources.shared import load, materialise

DIM, THRESHOLD, LENGTH_RATIO = 256, 0.92, 0.4
COUNTED, LONG = 65_536, 100


def hashed_vector(text: str, dim: int = DIM) -> np.ndarray:
    """A unit vector of the text's letter trigrams, the same on every machine."""
    v = np.zeros(dim, np.float32)
    padded = f"^{text}$"
    for i in range(max(1, len(padded) - 2)):
        h = xxhash.xxh64_intdigest(padded[i : i + 3])
        v[h % dim] += 1 if h >> 63 else -1
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def embedded(names: DataFrame, text_col: str) -> DataFrame:
    """Names with ``unit``, the hashed vector of the text as float32 bytes; null is the empty text."""
    fields = names.schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(unit=[hashed_vector(t or "").tobytes() for t in b[text_col]])

    return names.mapInPandas(run, f"{fields}, unit binary")


def trigrams(name: str) -> list[str]:
    """The letter trigrams of the padded name."""
    padded = f"^{name}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def frequent_trigrams(names: DataFrame) -> dict[str, dict[str, int]]:
    """By type how often the COUNTED most frequent trigrams of all stand in its names, without those that stand there once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, own in b.groupby("entity_type")["canon"]:
                held: Counter = Counter()
                for name in own:
                    held.update(trigrams(name))
                yield pd.DataFrame({"entity_type": kind, "gram": list(held), "n": list(held.values())})

    counts = names.select("entity_type", "canon").mapInPandas(run, "entity_type string, gram string, n long")
    counts = counts.groupBy("entity_type", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    found: dict[str, dict[str, int]] = {}
    for r in counts.orderBy(F.desc("n"), "entity_type", "gram").limit(COUNTED).collect():
        found.setdefault(r["entity_type"], {})[r["gram"]] = r["n"]
    return found


def name_keys(names: DataFrame, least: float) -> DataFrame:
    """(key, id, bits, norm): the keys under which names (id, entity_type, canon) of a cosine of ``least`` or more meet.

    A type's trigrams are put in one order, rare ones first. A key is two trigrams of a name such that the first of them
    with all from the second on has a norm of at least ``least`` times the whole: if two names share these two first, all
    they share lies there, so both have the key. For names that share one trigram only a key is one trigram with such a
    norm. A name's keys grow with the square of its length, so names above LONG letters meet under single trigrams
    instead, those that have such a norm with all behind them; so do names of LENGTH_RATIO times LONG or more, which may
    meet one. ``bits`` has the bit of each trigram's hash set; ``norm`` is squared.
    """
    counted = names.sparkSession.sparkContext.broadcast(frequent_trigrams(names))

    def place(kind: str, gram: str) -> tuple[int, str, int, int]:
        h = xxhash.xxh64_intdigest(f"{kind}\0{gram}")
        return counted.value.get(kind, {}).get(gram, 0), gram, h, 1 << (h >> 58)

    def keys_of(kind: str, name: str, placed: Callable, first: list[int], second: list[int]) -> tuple[int, int, float]:
        """Adds the hashes of the keys' two trigrams, 0 for none; gives the number of keys, the bits and the norm."""
        counts, before = Counter(trigrams(name)), len(first)
        order = sorted([placed(kind, g) for g in counts])
        squares, hashes, bits = [counts[g] ** 2 for _, g, _, _ in order], [h for _, _, h, _ in order], 0
        for _, _, _, bit in order:
            bits |= bit
        norm, top, single = sum(squares), max(squares), len(name) >= LENGTH_RATIO * LONG
        need, left = least * least * norm, norm
        for j, h in enumerate(hashes):  # left: of the trigrams from j on
            if squares[j] >= need or (single and left >= need):
                first.append(h)
                second.append(0)
            if len(name) <= LONG:
                for i in range(j):
                    if squares[i] + left >= need:
                        first.append(hashes[i])
                        second.append(h)
            left -= squares[j]
            if top + left < need:
                break
        return len(first) - before, bits, float(norm)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        placed = lru_cache(262_144)(place)
        for b in batches:
            first: list[int] = []
            second: list[int] = []
            held = [keys_of(kind, name, placed, first, second) for kind, name in zip(b["entity_type"], b["canon"])]
            times = [n for n, _, _ in held]
            key = np.array(first, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(second, np.uint64)
            bits = np.array([x for _, x, _ in held], np.uint64).view(np.int64).repeat(times)
            yield pd.DataFrame({"key": key.view(np.int64), "id": b["id"].to_numpy(np.int64).repeat(times), "bits": bits, "norm": np.array([x for _, _, x in held], np.float64).repeat(times)})

    return names.mapInPandas(run, "key long, id long, bits long, norm double")


def similar_names(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity_type, a, b, cosine), a < b: all pairs of names of a type whose trigram vectors agree at ``threshold``, exactly.

    Names meet under ``name_keys``. Vectors of a given cosine have a squared distance of the two squared norms less twice
    the cosine times both norms, and every trigram by which they differ adds one or more to it; so does every bit by which
    their bits differ, so pairs with more such bits are dropped where they meet. Only the pairs that are left move on, as
    two numbers, and are verified by their names. Lengths must agree at LENGTH_RATIO.
    """
    least = threshold - 1e-9  # the cosine is rounded
    names = materialise(names.select(F.monotonically_increasing_id().alias("id"), "entity_type", "canon"), "names")
    keys = name_keys(names, least)
    a, b = (keys.select("key", F.col("id").alias(f"id_{x}"), F.col("bits").alias(f"bits_{x}"), F.col("norm").alias(f"norm_{x}")) for x in "ab")
    distance = F.col("norm_a") + F.col("norm_b") - F.lit(2 * least) * F.sqrt(F.col("norm_a") * F.col("norm_b"))
    met = a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= distance))
    met = met.select("id_a", "id_b").distinct()
    x, y = (names.select(F.col("id").alias(f"id_{s}"), F.col("entity_type").alias(f"type_{s}"), F.col("canon").alias(f"name_{s}")) for s in "ab")
    met = met.join(x, "id_a").join(y, "id_b").where("type_a = type_b")
    met = met.select(F.col("type_a").alias("entity_type"), F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"))
    met = met.where(F.least(F.length("a"), F.length("b")) >= LENGTH_RATIO * F.greatest(F.length("a"), F.length("b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm = lambda x: float(sum(c * c for c in x.values()))
        for d in batches:
            held = [(Counter(trigrams(a)), Counter(trigrams(b))) for a, b in zip(d["a"], d["b"])]
            yield d.assign(dot=[float(sum(c * y[g] for g, c in x.items())) for x, y in held], norm_a=[norm(x) for x, _ in held], norm_b=[norm(y) for _, y in held])

    dots = met.mapInPandas(run, "entity_type string, a string, b string, dot double, norm_a double, norm_b double")
    return dots.select("entity_type", "a", "b", F.round(F.col("dot") / F.sqrt(F.col("norm_a") * F.col("norm_b")), 9).alias("cosine")).where(F.col("cosine") >= threshold)


def min_label_groups(edges: DataFrame) -> DataFrame:
    """(id, group): the smallest id linked to each id directly or through others; labels jump over their own labels.

    Each round sends every id the least label of its neighbours, then replaces a label by its label's label, so chains
    shrink by halves. Every round is written to the shared folder, which cuts the lineage.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = materialise(both, "link-edges")
    labels = materialise(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.min("x")).alias("group")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["id"]).groupBy(F.col("x").alias("id")).agg(F.min("group").alias("near"))
        step = labels.join(near, "id").select("id", F.least("group", "near").alias("group"))
        jump = step.select(F.col("id").alias("group"), F.col("group").alias("far"))
        fresh = materialise(step.join(jump, "group", "left").select("id", F.least("group", F.coalesce("far", "group")).alias("group")), "labels")
        changed = fresh.join(labels.withColumnRenamed("group", "old"), "id").where(F.col("group") != F.col("old")).limit(1).count()
        labels = fresh
        if not changed:
            return labels


def linked_entities(nodes: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity_id, keeper, size) of entities of one type whose names are linked by ``similar_names``, directly or through others.

    Trigram vectors stand in for a model's; equal names are one row of the join. The keeper of a group has most mentions,
    then the smallest id. Null names and types take no part; edges of other entities count for nothing.
    """
    named = nodes.where(F.col("entity_type").isNotNull()).select("entity_id", "entity_type", canonical_form(F.col("name")).alias("canon"))
    named = materialise(named, "named").where(F.col("canon") != "")  # tested as read, so that it is made once
    pairs = similar_names(named.select("entity_type", "canon").distinct(), threshold)
    tag = lambda c: F.concat_ws("\u0001", "entity_type", c)
    groups = min_label_groups(materialise(pairs.select(tag("a").alias("a"), tag("b").alias("b")), "name-links"))
    grouped = named.select("entity_id", tag("canon").alias("id")).join(groups, "id", "left").select("entity_id", F.coalesce("group", "id").alias("g"))
    sizes = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    grouped = materialise(grouped.join(sizes, "g"), "linked")
    degree = edges.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    grouped = materialise(grouped.join(degree, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "linked-degrees")
    best = grouped.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), "entity_id"))["entity_id"].alias("keeper"))
    return grouped.join(best, "g").select("entity_id", "keeper", "size")


def g24_linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "mentions").where(F.col("chunk_id").isNotNull() & F.col("entity_id").isNotNull()).select("chunk_id", "entity_id").distinct()
    return linked_entities(entities(spark, sf_dir), m)


QUERIES = {"g24_linked_entities": g24_linked_entities}
ORACLE = {
    "g24_linked_entities": _G + """, nm AS (SELECT DISTINCT entity_type, canon FROM cf WHERE canon <> '' AND entity_type IS NOT NULL), tg AS (SELECT entity_type, canon, substring(p, i, 3) AS gram, count(*) AS c FROM (SELECT *, '^' || canon || '$' AS p, unnest(range(1, length('^' || canon || '$') - 1)) AS i FROM nm) GROUP BY 1, 2, 3),
        no AS (SELECT entity_type, canon, sum(c * c) AS q FROM tg GROUP BY 1, 2), dt AS (SELECT x.entity_type, x.canon AS a, y.canon AS b, sum(x.c * y.c) AS d FROM tg x JOIN tg y ON x.entity_type = y.entity_type AND x.gram = y.gram AND x.canon < y.canon GROUP BY 1, 2, 3),
        lk AS (SELECT dt.entity_type, a, b FROM dt JOIN no x ON x.entity_type = dt.entity_type AND x.canon = a JOIN no y ON y.entity_type = dt.entity_type AND y.canon = b WHERE round(d / sqrt(x.q * y.q), 9) >= 0.92 AND least(length(a), length(b)) >= 0.4 * greatest(length(a), length(b))),
        ed AS (SELECT entity_type, a, b FROM lk UNION SELECT entity_type, b, a FROM lk), rc AS (SELECT entity_type, canon AS a, canon AS b FROM nm UNION SELECT rc.entity_type, rc.a, ed.b FROM rc JOIN ed ON ed.entity_type = rc.entity_type AND ed.a = rc.b),
        gr AS (SELECT entity_type, a AS canon, min(b) AS g FROM rc GROUP BY 1, 2), mb AS (SELECT cf.entity_id, cf.n, gr.entity_type, g FROM cf JOIN gr ON gr.entity_type = cf.entity_type AND gr.canon = cf.canon)
        SELECT entity_id, first_value(entity_id) OVER (PARTITION BY entity_type, g ORDER BY n DESC, entity_id) AS keeper, count(*) OVER (PARTITION BY entity_type, g) AS size FROM mb QUALIFY size > 1""",
}
