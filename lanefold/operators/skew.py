"""Per-key work that a few heavy keys cannot unbalance.

``offset_chunks`` numbers the rows of a table in key order without sending a key to one task: rows are
counted per (key, input partition), the counts are prefix-summed into exact start offsets, and each row's
number is its offset plus its place within its own (key, partition). Rows are then dealt to chunks of equal
size, so a key that holds a third of the table is worked on by a third of the chunks.

``attach`` joins rows to a table with one row per key. The keys whose rows exceed 1/MAX_HEAVY of the whole
are, by counting, fewer than MAX_HEAVY, so only they are broadcast; all others meet in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.sources.shared import materialise

MAX_HEAVY = 1000


def attach(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with ``unique`` (one row per key) on ``key`` without a hot task.

    ``weight`` names the column of ``unique`` that holds a key's number of rows, ``total`` their sum. Heavy keys
    (weight * MAX_HEAVY > total, so fewer than MAX_HEAVY of them) are broadcast. A null key matches nothing:
    its rows are dropped by ``inner`` and kept by ``left``. The weight column stays in the result.
    """
    heavy = unique.where((F.col(weight) * MAX_HEAVY > F.lit(total)) & F.col(key).isNotNull())
    marks = F.broadcast(heavy.select(F.col(key).alias("_heavy_key")))
    split = rows.join(marks, rows[key] == F.col("_heavy_key"), "left")
    hot = split.where(F.col("_heavy_key").isNotNull()).drop("_heavy_key").join(F.broadcast(heavy), key)
    light = unique.where(~(F.col(weight) * MAX_HEAVY > F.lit(total)) | F.col(weight).isNull())
    rest = split.where(F.col("_heavy_key").isNull()).drop("_heavy_key").join(light, key, how)
    return hot.unionByName(rest)


def attach_counted(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``attach`` for a table whose keys' numbers of rows are not known yet: they are counted by partial aggregation first."""
    counts = materialise(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_weight")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
    held = materialise(counts.join(unique, key), "counted")
    return attach(rows, held, key, "_weight", total, how).drop("_weight")


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, block_rows: int = 1000) -> DataFrame:
    """All pairs of a left and a right row with equal keys, hot keys cut into square blocks.

    A key with more than block_rows right rows is dealt into parts on both sides by the hash of the ids, and every pair of
    parts meets as a block of its own, about block_rows right rows at most. There are at most right rows / block_rows such
    keys, so the join that marks them is small on one side. Null keys meet nothing.
    """
    keys = list(keys)
    hot = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts"))
    hot = materialise(hot, "hot-keys")

    def dealt(rows: DataFrame, own: str, other: str, id_col: str) -> DataFrame:
        parts = F.coalesce("_parts", F.lit(1))
        marked = rows.join(hot, keys, "left").withColumn("_parts", parts)
        return marked.select(*rows.columns, F.pmod(F.xxhash64(id_col), "_parts").cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias(other))

    return dealt(left, "_i", "_j", left_id).join(dealt(right, "_j", "_i", right_id), [*keys, "_i", "_j"]).drop("_i", "_j")


def offset_chunks(rows: DataFrame, keys: Sequence[str], chunk_rows: int, within: Sequence[str] = ()) -> DataFrame:
    """rows with ``_row`` (0-based number in key order) and ``_chunk`` = _row div chunk_rows.

    The order is by ``keys``, inside a key by input partition, and inside a partition by the columns ``within``: rows
    that come range-partitioned by (keys, within) are numbered in that order throughout. The row data is written once
    to the shared folder, so that partition numbers cannot change under a lost executor; besides it only one count per
    (key, partition) is moved, then the rows meet their offsets on (key, partition), which spreads a heavy key over all
    input partitions. Null keys form a key of their own, repeated rows get numbers of their own, and an empty table
    gives an empty result.
    """
    keys = list(keys)
    placed = materialise(
        rows.sortWithinPartitions(*keys, *within).withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "offset-rows",
    )
    counts = placed.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_base"))
    ordered = materialise(
        counts.repartitionByRange(*keys, "_pid").withColumn("_part", F.spark_partition_id()), "offset-counts"
    )
    parts = ordered.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row a partition
    before = Window.partitionBy("_part").orderBy(*keys, "_pid").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    ordered = ordered.join(F.broadcast(parts), "_part")
    offsets = ordered.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), (first - F.col("_base")).alias("_shift")
    )
    on = [F.col("_pid") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    row = F.col("_shift") + F.col("_pos")
    return placed.join(offsets, on).select(*rows.columns, row.alias("_row"), F.floor(row / F.lit(chunk_rows)).cast("long").alias("_chunk"))


def chunked_agg(numbered: DataFrame, keys: Sequence[str], states: dict[str, Column], merges: dict[str, Column]) -> DataFrame:
    """Per-key results from equal-sized chunks.

    Each chunk is one shuffle key and reduces its own rows with ``states``; a key that spans several chunks then leaves
    one boundary state per chunk, and ``merges`` joins these few states per key.
    """
    keys = list(keys)
    per_chunk = (
        numbered.repartition(F.col("_chunk")).groupBy("_chunk", *keys).agg(*[c.alias(n) for n, c in states.items()])
    )
    return per_chunk.groupBy(*keys).agg(*[c.alias(n) for n, c in merges.items()])


def extension_sums(counts: DataFrame, text: str, weight: str, name: str) -> DataFrame:
    """(text, name): for each distinct text the weight of all texts that begin with it and go on.

    In byte order these follow the text directly, up to the text with the last code point behind it. So texts and such
    end marks are sorted together, running sums are taken over the range partitions, and each text subtracts the sum at
    itself from that at its end mark: two rows a text, whatever its length. Null texts are left out.
    """
    held = counts.where(F.col(text).isNotNull())
    sides = F.explode(F.array(F.struct(F.col(text).alias("_k"), F.col(weight).alias("_w"), F.lit(0).alias("_end")), F.struct(F.concat(text, F.lit("\U0010ffff")).alias("_k"), F.lit(0).cast("long").alias("_w"), F.lit(1).alias("_end"))))
    rows = materialise(held.select(text, sides.alias("x")).select(text, "x.*").repartitionByRange("_k", "_end").withColumn("_part", F.spark_partition_id()), "text-order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = rows.groupBy("_part").agg(F.sum("_w").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    running = F.sum("_w").over(Window.partitionBy("_part").orderBy("_k", "_end"))
    placed = rows.withColumn("_run", running).join(F.broadcast(parts), "_part").withColumn("_run", F.col("_run") + F.col("_before"))
    at = lambda end: F.max(F.when(F.col("_end") == end, F.col("_run")))
    return placed.groupBy(text).agg((at(1) - at(0)).alias(name))


def numbered(rows: DataFrame, keys: Sequence[str], order: dict[str, Column], chunk_rows: int = 100_000) -> DataFrame:
    """rows with ``_place`` (1-based within keys, by the named order columns) and ``_chunk``, however many rows a key has.

    ``order`` must place rows totally; its columns are added to the rows under their names.
    """
    keys = list(keys)
    named = rows.withColumns(order)
    placed = offset_chunks(named.repartitionByRange(*keys, *order), keys, chunk_rows, list(order))
    firsts = placed.groupBy(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    on = [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)]
    return placed.join(firsts, on).select(*placed.columns, "_n", (F.col("_row") - F.col("_first") + 1).alias("_place"))


def prefix_sums(placed: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """placed (from ``numbered``) with the running sum of ``value`` in order: chunk totals are summed, then each chunk."""
    keys = list(keys)
    held = placed.withColumn("_v", value)
    totals = held.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_sc"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    on = [F.col("_chunk") == F.col("_sc"), *[F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]]
    local = Window.partitionBy(*keys, "_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.join(starts, on).withColumn(name, F.col("_start") + F.sum("_v").over(local)).select(*placed.columns, name)
