from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lanefold.operators.mentions import entity_profile, heavy_entities
from lanefold.operators.skew import attach, attach_counted, block_join, extension_sums, numbered, offset_chunks, prefix_sums


def edges(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, entity_id string, linked_at timestamp, count int")


def test_profile_of_a_hot_key_matches_a_plain_aggregate(spark):
    t = datetime(2025, 1, 1)
    rows = [(f"c{i}", "hot", t.replace(day=1 + i % 28), 0) for i in range(900)] + [(f"c{i}", f"e{i % 40}", t, 0) for i in range(300)] + [("c1", "hot", t, 1)] * 5 + [(None, "e1", None, 0), ("c1", None, t, 0)]
    df = edges(spark, rows)
    got = {r["entity_id"]: (r["n_chunks"], r["first_linked_at"], r["last_linked_at"]) for r in entity_profile(df, chunk_rows=50).collect()}
    want = df.where("entity_id is not null").groupBy("entity_id").agg(F.countDistinct("chunk_id"), F.min("linked_at"), F.max("linked_at")).collect()
    assert got == {r[0]: (r[1], r[2], r[3]) for r in want}
    assert [r[0] for r in heavy_entities(entity_profile(df), 0.3).collect()] == ["hot"]


def test_profile_of_an_empty_table(spark):
    assert entity_profile(edges(spark, [])).count() == 0
    assert heavy_entities(entity_profile(edges(spark, []))).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_rows_are_numbered_once_in_key_order_and_chunks_are_equal(spark, partitions):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"), "id").repartition(partitions)
    out = offset_chunks(df, ["k"], 100).collect()
    assert sorted(r["_row"] for r in out) == list(range(1000))
    assert [r["k"] for r in sorted(out, key=lambda r: r["_row"])] == sorted(r["k"] for r in out)
    sizes = {}
    for r in out:
        sizes[r["_chunk"]] = sizes.get(r["_chunk"], 0) + 1
    assert set(sizes.values()) == {100}


def test_numbering_with_ties_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), (None, 5), (None, 5), ("b", None)], "k string, v int")
    out = numbered(df, ["k"], {"_v": F.col("v")}, 2).collect()
    assert sorted((r["k"] or "", r["_place"]) for r in out) == [("", 1), ("", 2), ("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    sums = prefix_sums(numbered(df.where("k = 'a'"), ["k"], {"_v": F.col("v")}, 2), ["k"], F.col("v"), "s").orderBy("_place").collect()
    assert [r["s"] for r in sums] == [1, 2, 4]


def test_attach_keeps_every_row_of_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([("hot",)] * 3000 + [("x",), ("y",), (None,)], "k string")
    unique = rows.where("k is not null").groupBy("k").agg(F.count("k").alias("n"))
    assert attach(rows, unique, "k", "n", 3003).count() == 3002
    assert attach(rows, unique, "k", "n", 3003, "left").count() == 3003


def test_extension_sums_match_brute_force(spark):
    texts = ["a", "ab", "abc", "b", "", "ab\u00e9", "abz", "\U0010ffff", "a\U0001f600", "ba"]
    df = spark.createDataFrame([(t, i + 1) for i, t in enumerate(texts)] + [(None, 5)], "t string, n long")
    got = {r["t"]: r["x"] for r in extension_sums(df, "t", "n", "x").collect()}
    assert got == {t: sum(j + 1 for j, u in enumerate(texts) if u != t and u.startswith(t)) for t in texts}
    assert extension_sums(df.limit(0), "t", "n", "x").count() == 0


def test_block_join_pairs_everything_once_also_in_a_hot_key(spark):
    rows = [("hot", f"h{i}") for i in range(90)] + [("k", "a"), ("k", "b"), (None, "n"), ("lone", "l")]
    df = spark.createDataFrame(rows, "k string, id string")
    got = [(r["a"], r["b"]) for r in block_join(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), ["k"], "a", "b", 20).collect()]
    want = {(a, b) for k, a in rows for m, b in rows if k is not None and k == m}
    assert len(got) == len(set(got)) and set(got) == want
    assert block_join(df.limit(0).withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), ["k"], "a", "b").count() == 0


def test_attach_counted_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [("k", 1), ("none", 2), (None, 3)], "k string, v int")
    names = spark.createDataFrame([("hot", "H"), ("k", "K"), ("unused", "U")], "k string, name string")
    got = attach_counted(rows, names, "k").groupBy("k", "name").count().collect()
    assert {(r["k"], r["name"], r["count"]) for r in got} == {("hot", "H", 3000), ("k", "K", 1)}


def test_intermediate_tables_can_be_released(spark):
    from pathlib import Path

    from lanefold.sources import shared

    kept = shared.materialise(spark.range(3), "x")
    folder = Path(shared.own_folder(spark).removeprefix("file://"))
    assert kept.count() == 3 and any(folder.iterdir())
    shared.release(spark)
    assert not folder.exists() and shared.materialise(spark.range(2), "x").count() == 2
