"""Readers and writers as queries: tables are written in each format below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators import graph
from lanefold.sources import loaders
from lanefold.sources.shared import load, place


def s05_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a JSON line and as an element of a JSON array, read back by suffix."""
    d = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull())
    rows = d.select(F.col("doc_id").cast("string").alias("id"), "text")
    root = place(spark, "documents")
    rows.write.json(f"{root}/lines")
    rename(spark, f"{root}/lines", ".json", ".jsonl")
    loaders.json_arrays(rows, F.xxhash64("id"), f"{root}/arrays", 200)
    rename(spark, f"{root}/arrays", ".txt", ".json")
    return loaders.read_documents(spark, root).select("id", F.md5("text").alias("text_md5"), "format")


def rename(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Gives the data files below path another suffix."""
    fs, p = loaders.fs_of(spark, path)
    files = fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath()
        if f.getName().endswith(old):
            fs.rename(f, loaders.fs_of(spark, f.toString()[: -len(old)] + new)[1])


def s13_chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as JSON arrays."""
    c = load(spark, sf_dir, "chunk_extractions").where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max("text").alias("text"), F.max("source_file").alias("source_file"))
    path = place(spark, "chunks")
    loaders.json_arrays(c, F.xxhash64("chunk_id"), path, 500)
    return loaders.read_chunks(spark, path).select("chunk_id", F.md5("text").alias("text_md5"), "source_file")


def s14_extraction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results below a metadata object."""
    c = load(spark, sf_dir, "chunk_extractions").where(F.col("chunk_id").isNotNull()).select("chunk_id", "text", "entities", "relations", "extraction_time_ms").distinct()
    path = place(spark, "extractions")
    loaders.json_arrays(c, F.xxhash64("chunk_id"), path, 500, lambda x: F.struct(F.struct(F.lit("1").alias("version")).alias("metadata"), x.alias("results")))
    return loaders.read_extractions(spark, path).select("chunk_id", F.coalesce(F.size("entities"), F.lit(-1)).alias("n_entities"), F.coalesce(F.size("relations"), F.lit(-1)).alias("n_relations")).distinct()


def s16_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended as JSON lines beside a broken line, which is left out; a missing path has none."""
    r = load(spark, sf_dir, "agentic_ablation").where(F.col("question_id").isNotNull())
    path = place(spark, "records")
    loaders.write_records(r, path)
    spark.createDataFrame([('{"question_id": "broken', )], "value string").write.mode("append").text(f"{path}/row_name=broken")
    back = loaders.read_records(spark, path).unionByName(loaders.read_records(spark, path + "-none"), allowMissingColumns=True)
    return back.select("question_id", "dataset", F.round("f1_score", 6).alias("f1"), "retrieval_count").distinct()


def s18_question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions saved and loaded."""
    q = load(spark, sf_dir, "agentic_ablation").where(F.col("question_id").isNotNull()).groupBy(F.col("question_id").alias("id")).agg(F.max("question").alias("question"), F.max("gold_answer").alias("answer"), F.max("question_type").alias("question_type"))
    path = place(spark, "questions")
    loaders.write_questions(q, path)
    return loaders.read_questions(spark, path).select("id", "question", "answer", "question_type")


def w01_vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings appended in two batches to a vector store; norms of what is stored."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = place(spark, "vectors")
    for half in (0, 1):
        loaders.write_vectors(e.where(F.col("vec_id") % 2 == half), path, "embedding")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dim"), F.round(F.sqrt(square), 4).alias("norm"))


def w07_graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges committed together, a second transaction that renames some nodes, and one rolled back."""
    root = place(spark, "graph")
    nodes = graph.entities(spark, sf_dir).select("entity_id", "name", "entity_type", F.lit(1).alias("seq"))
    with loaders.Transaction(spark) as t:
        t.nodes("Entity", nodes, root, "seq")
        t.edges("RELATED_TO", graph.related(spark, sf_dir).withColumn("seq", F.lit(1)), root, "seq")
    newer = nodes.where(F.col("entity_type") == "GPE").withColumns({"name": F.upper("name"), "seq": F.lit(2)})
    with loaders.Transaction(spark) as t:
        t.nodes("Entity", newer, root, "seq")
    lost = loaders.Transaction(spark)
    lost.nodes("Entity", nodes.withColumns({"name": F.lit("lost"), "seq": F.lit(3)}), root, "seq")
    lost.rollback()
    e = loaders.read_table(spark, f"{root}/Entity").select(F.lit("Entity").alias("item"), F.col("entity_id").alias("a"), F.coalesce("name", F.lit("")).alias("b"))
    r = loaders.read_table(spark, f"{root}/RELATED_TO").select(F.lit("RELATED_TO").alias("item"), F.col("src").alias("a"), F.concat_ws("/", "relation_type", "dst").alias("b"))
    return e.unionByName(r)


def w26_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph import as phases with resume: chunks, entities, mentions, relations, co-occurrence, cleanup; rows of each."""
    phases = [
        ("chunks", lambda _: graph.chunks(spark, sf_dir)), ("entities", lambda _: graph.entities(spark, sf_dir)), ("mentions", lambda _: graph.mentions(spark, sf_dir)),
        ("relations", lambda _: graph.related(spark, sf_dir)), ("cooccurrence", lambda _: graph.cooccurrence_edges(spark, sf_dir)), ("dropped", lambda _: graph.dropped(spark, sf_dir)),
        ("kept", lambda t: t["entities"].join(t["dropped"], "entity_id", "left_anti")),
    ]
    root = place(spark, "import")
    loaders.staged_import(spark, root, phases[:3], sf_dir)
    done = loaders.staged_import(spark, root, phases, sf_dir)  # the first three phases are found complete
    out = None
    for name, df in done.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("phase"), "n")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (s05_document_files, s13_chunk_files, s14_extraction_files, s16_record_files, s18_question_files, w01_vector_store, w07_graph_store, w26_import)}

_G = graph._G
ORACLE = {
    "s05_document_files": "SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, format FROM documents, (VALUES ('json'), ('jsonl')) f(format) WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') AND doc_id IS NOT NULL",
    "s13_chunk_files": "SELECT chunk_id, md5(max(text)) AS text_md5, max(source_file) AS source_file FROM chunk_extractions WHERE chunk_id IS NOT NULL GROUP BY 1",
    "s14_extraction_files": "SELECT DISTINCT chunk_id, coalesce(len(entities), -1) AS n_entities, coalesce(len(relations), -1) AS n_relations FROM chunk_extractions WHERE chunk_id IS NOT NULL",
    "s16_record_files": "SELECT DISTINCT question_id, dataset, round(f1_score, 6) AS f1, retrieval_count FROM agentic_ablation WHERE question_id IS NOT NULL",
    "s18_question_files": "SELECT question_id AS id, max(question) AS question, max(gold_answer) AS answer, max(question_type) AS question_type FROM agentic_ablation WHERE question_id IS NOT NULL GROUP BY 1",
    "w01_vector_store": "SELECT vec_id, len(embedding) AS dim, CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 THEN 0 ELSE 1 END::DOUBLE AS norm FROM embeddings",
    "w07_graph_store": _G + " SELECT 'Entity' AS item, entity_id AS a, coalesce(CASE WHEN entity_type = 'GPE' THEN upper(name) ELSE name END, '') AS b FROM en UNION ALL SELECT 'RELATED_TO', src, relation_type || '/' || dst FROM re",
    "w26_import": _G + f""", d AS (SELECT entity_id, CASE WHEN canon IN ({', '.join(repr(x) for x in graph.STOPLIST)}) THEN 'stoplist' WHEN lone THEN 'orphan' WHEN n > greatest(50, 0.03 * (SELECT count(*) FROM ch)) THEN 'hub' END AS reason FROM cf)
        SELECT 'chunks' AS phase, count(*) AS n FROM ch UNION ALL SELECT 'entities', count(*) FROM en UNION ALL SELECT 'mentions', count(*) FROM me UNION ALL SELECT 'relations', count(*) FROM re UNION ALL SELECT 'cooccurrence', count(*) FROM co
        UNION ALL SELECT 'dropped', count(*) FROM d WHERE reason IS NOT NULL UNION ALL SELECT 'kept', count(*) FROM d WHERE reason IS NULL""",
}
