"""Readers and writers: documents from files, question sets, chunk and extraction exports, records; stores as Parquet."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.functions.text import short_hash, source_id

CHUNK = "chunk_id string, text string, source_file string, chunk_index bigint, position bigint, page_number bigint, metadata map<string,string>"
ENTITY = "entity_id string, name string, entity_type string, confidence double, mention_span array<int>, source_chunk_id string"
RELATION = "subject_entity string, relation_type string, object_entity string, confidence double, source_chunk_ids array<string>"
RESULT = f"chunk_id string, text string, entities array<struct<{ENTITY.replace(' ', ':').replace(',:', ',')}>>, relations array<struct<{RELATION.replace(' ', ':').replace(',:', ',')}>>, extraction_time_ms double"
RECORD = (
    "question_id string, question string, gold_answer string, predicted_answer string, exact_match boolean, f1_score double, retrieval_count int, time_ms double, "
    "dataset string, question_type string, answer_correct boolean, gold_titles array<string>, retrieved_titles array<string>, retrieval_recall double, "
    "retrieval_precision double, all_gold_retrieved boolean, llm_error boolean, planner_query_type string, hop_count int, n_entities int, verifier_iterations int, confidence string"
)
SUFFIXES = {"txt": "text", "md": "text", "json": "json", "jsonl": "jsonl"}


class QuestionSet(Protocol):
    """A question set gives its articles and its questions as tables."""

    def load(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]: ...


class Embedder(Protocol):
    """Extension point: adds a vector column to a table of texts."""

    def embed(self, texts: DataFrame, text_col: str) -> DataFrame: ...


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _text_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("source"))


def item_document(raw: Column, source: Column) -> Column:
    """(id, text, source) of one JSON item: context, else text, content, passage, else the item itself."""
    v = F.from_json(raw, "id string, _id string, text string, content string, passage string, context array<string>")
    pairs = F.from_json(F.get_json_object(raw, "$.context"), "array<array<string>>")
    flat = F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", F.try_element_at(p, F.lit(1)), F.array_join(F.coalesce(F.from_json(F.try_element_at(p, F.lit(2)), "array<string>"), F.slice(p, 2, 1)), " "))), "\n")
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.struct(F.coalesce(v["id"], v["_id"], source_id(source)).alias("id"), F.coalesce(blank(flat), blank(v["text"]), blank(v["content"]), blank(v["passage"]), raw).alias("text"), source.alias("source"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, source, format) of all .txt, .md, .json and .jsonl files below path; other files are skipped.

    A text file is one document, a JSON array one per element, a JSON object one, a JSON line one; a broken line is left
    out alone. A path that is not there raises FileNotFoundError.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    plain = _text_files(spark, path, "*.{txt,md}").select(source_id(F.col("source")).alias("id"), F.col("value").alias("text"), "source", F.lit("text").alias("format"))
    whole = _text_files(spark, path, "*.json").withColumn("items", F.when(F.trim("value").startswith("["), F.transform(F.from_json("value", "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array("value")))
    items = whole.select("source", F.posexplode("items").alias("i", "raw"), F.size("items").alias("n"), F.trim("value").startswith("[").alias("many"))
    name = F.when(F.col("many"), F.concat_ws(":", "source", "i")).otherwise(F.col("source"))
    json = items.where(F.col("raw").isNotNull()).select(item_document(F.col("raw"), name).alias("d")).select("d.*", F.lit("json").alias("format"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).select(F.trim("value").alias("raw"), F.col("_metadata.file_path").alias("f"))
    lines = lines.where((F.col("raw") != "") & F.try_parse_json("raw").isNotNull())
    jsonl = lines.select(item_document(F.col("raw"), F.concat_ws(":", "f", short_hash(F.col("raw"), 8))).alias("d")).select("d.*", F.lit("jsonl").alias("format"))
    return plain.unionByName(json).unionByName(jsonl)


def first_title(articles: DataFrame) -> DataFrame:
    """One article per title: that of the smallest (question, place)."""
    return articles.groupBy("title").agg(F.min(F.struct("qid", "i", "sentences")).alias("x")).select("title", "x.sentences")


def paired_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, questions) of sets whose items hold context [[title, [sentences]]] and supporting_facts."""
    raw = spark.read.schema("_id string, id string, question string, answer string, type string, level string, context string, supporting_facts string").json(path, multiLine=True)
    q = raw.withColumn("qid", F.coalesce("_id", "id"))
    pairs = F.from_json("context", "array<array<string>>")
    a = q.select("qid", F.posexplode(pairs).alias("i", "p")).select("qid", "i", F.try_element_at("p", F.lit(1)).alias("title"), F.from_json(F.try_element_at("p", F.lit(2)), "array<string>").alias("sentences"))
    facts = F.transform(F.from_json("supporting_facts", "array<array<string>>"), lambda f: F.struct(f[0].alias("title"), f[1].cast("int").alias("sent_id")))
    return first_title(a.where(F.col("title").isNotNull())), q.select(F.col("qid").alias("id"), "question", "answer", F.col("type").alias("question_type"), "level", facts.alias("supporting_facts"))


def decomposed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs with gold titles from the decomposition's support places, else from the supporting flags."""
    schema = "id string, question string, answer string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<paragraph_support_idx:int>>"
    r = spark.read.schema(schema).json(path)
    a = r.select(F.col("id").alias("qid"), F.posexplode("paragraphs").alias("i", "p")).select("qid", "i", "p.title", F.array("p.paragraph_text").alias("sentences"))
    by_place = F.filter(F.transform("question_decomposition", lambda d: F.try_element_at(F.col("paragraphs"), d["paragraph_support_idx"] + 1)["title"]), lambda t: t.isNotNull())
    flagged = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: p["title"])
    gold = F.array_distinct(F.when(F.size(by_place) > 0, by_place).otherwise(flagged))
    return first_title(a.where(F.col("title").isNotNull())), r.select("id", "question", "answer", gold.alias("gold_titles"))


def yes_no_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Boolean or 0/1 answers as yes and no; facts of more than ten characters become articles."""
    r = spark.read.schema("qid string, question string, answer string, facts array<string>").json(path, multiLine=True)
    a = r.select("qid", F.posexplode("facts").alias("i", "fact")).where(F.length("fact") > 10)
    a = a.select("qid", "i", F.concat_ws("_", "qid", F.lit("fact"), "i").alias("title"), F.array("fact").alias("sentences"))
    return a.select("title", "sentences"), r.select(F.col("qid").alias("id"), "question", F.when(F.lower("answer").isin("true", "1", "yes"), "yes").otherwise("no").alias("answer"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """S13, S15."""
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """The results of an extraction export."""
    return spark.read.schema(f"results array<struct<{','.join(_fields(RESULT))}>>").json(path, multiLine=True).select(F.inline("results"))


def _fields(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A saved questions.json, one array of question objects."""
    return spark.read.schema("id string, question string, answer string, question_type string, level string, supporting_facts array<array<string>>").json(path, multiLine=True)


def write_questions(questions: DataFrame, path: str, per_file: int = 500) -> None:
    """Questions as JSON arrays, per_file to a file."""
    json_arrays(questions, F.xxhash64("id"), path, per_file)


def json_arrays(rows: DataFrame, key: Column, path: str, per_file: int = 500, wrap: Callable[[Column], Column] = lambda c: c) -> None:
    """Rows as files of one JSON document each, of about per_file rows by the key's hash."""
    n = max(1, -(-rows.count() // per_file))
    held = rows.select(F.pmod(key, F.lit(n)).cast("int").alias("part"), F.struct(*rows.columns).alias("x"))
    docs = held.groupBy("part").agg(F.collect_list("x").alias("x")).select("part", F.to_json(wrap(F.col("x"))).alias("value"))
    docs.write.partitionBy("part").text(path)


def article_info(articles: DataFrame, first: int = 20) -> dict:
    """Number of articles and the first titles in byte order."""
    return {"count": articles.count(), "titles": [r[0] for r in articles.select("title").orderBy("title").limit(first).collect()]}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records of JSON lines; broken lines are dropped, and a path that is not there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json(path, mode="DROPMALFORMED").where(F.col("question_id").isNotNull())


def fs_of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, swapped in by an atomic rename: readers see the old or the new content."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, fresh = fs_of(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, target, rename)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small text file; None if it is not there."""
    if not exists(spark, path):
        return None
    fs, p = fs_of(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_vectors(vectors: DataFrame, path: str, vec: str, dim: int | None = None, metric: str = "cosine") -> int:
    """Appends normalised vectors; the first write fixes the dimension, another one raises ValueError.

    A zero vector stays zero. The store's dimension, metric and number of rows stand in a JSON file beside the data (W02).
    Returns the dimension.
    """
    spark = vectors.sparkSession
    meta = json.loads(get_text(spark, f"{path}/_meta.json") or "{}")
    held = meta.get("dim") or dim
    sizes = [r[0] for r in vectors.where(F.col(vec).isNotNull()).select(F.size(vec)).distinct().limit(2).collect()]
    want = held or (sizes[0] if sizes else 0)
    if any(s != want for s in sizes):
        raise ValueError(f"vectors of {sizes} values in a store of {want}")
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform(vec, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))
    vectors.withColumn(vec, unit).write.mode("append").parquet(path)
    put_text(spark, f"{path}/_meta.json", json.dumps({"dim": want, "metric": metric, "count": spark.read.parquet(path).count()}))
    return want


#: The key columns of every node and edge type.
NODE_KEYS = {"DocumentChunk": ["chunk_id"], "SourceDocument": ["source_file"], "Entity": ["entity_id"]}
EDGE_KEYS = {"FROM_SOURCE": ["chunk_id", "source_file"], "NEXT_CHUNK": ["chunk_id", "next_chunk_id"], "MENTIONS": ["chunk_id", "entity_id"], "RELATED_TO": ["src", "relation_type", "dst"]}
BUCKETS = 64


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows of an upserted table; None before the first commit."""
    manifest = json.loads(get_text(spark, f"{path}/_manifest.json") or "{}")
    return _parts(spark, manifest).drop("_bucket") if manifest else None


def _parts(spark: SparkSession, manifest: dict[str, str]) -> DataFrame:
    """The rows of every part from the version that the manifest names for it: at most BUCKETS versions."""
    out = None
    for version in sorted(set(manifest.values())):
        rows = spark.read.parquet(version).where(F.col("_bucket").isin([int(b) for b, v in manifest.items() if v == version]))
        out = rows if out is None else out.unionByName(rows)
    return out


class Transaction:
    """Upserts into several tables that show all together at commit, or not at all.

    A table is kept in BUCKETS parts by the hash of its keys. An upsert writes new versions of the touched parts only; the
    table's manifest, which names the version of every part, is swapped at commit by an atomic rename. Rollback, or an
    error inside the ``with`` block, deletes the new versions; a crash leaves the old manifests in force.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.staged = spark, {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.commit() if kind is None else self.rollback()

    def upsert(self, new: DataFrame, path: str, keys: list[str], order: str) -> None:
        """One row per key, that of the greatest ``order``, among the new rows and those of the touched parts."""
        manifest = self.staged.get(path) or json.loads(get_text(self.spark, f"{path}/_manifest.json") or "{}")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        fresh = new.withColumn("_bucket", bucket)
        touched = sorted(str(r[0]) for r in fresh.select("_bucket").distinct().collect())  # at most BUCKETS
        old = {t: manifest[t] for t in touched if t in manifest}
        both = _parts(self.spark, old).unionByName(fresh) if old else fresh
        w = Window.partitionBy("_bucket", *keys).orderBy(F.desc(order))
        version = f"{path}/v-{uuid.uuid4().hex[:12]}"
        both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i").write.parquet(version)
        self.staged[path] = {**manifest, **{t: version for t in touched}}

    def nodes(self, kind: str, new: DataFrame, root: str, order: str) -> None:
        """Nodes of a type; an unknown type raises KeyError."""
        self.upsert(new, f"{root}/{kind}", NODE_KEYS[kind], order)

    def edges(self, kind: str, new: DataFrame, root: str, order: str) -> None:
        """Edges of a type; an unknown type raises KeyError."""
        self.upsert(new, f"{root}/{kind}", EDGE_KEYS[kind], order)

    def commit(self) -> None:
        for path, manifest in self.staged.items():
            put_text(self.spark, f"{path}/_manifest.json", json.dumps(manifest))
        self.staged = {}

    def rollback(self) -> None:
        for path, manifest in self.staged.items():
            kept = set(json.loads(get_text(self.spark, f"{path}/_manifest.json") or "{}").values())
            for version in set(manifest.values()) - kept:
                fs, p = fs_of(self.spark, version)
                fs.delete(p, True)
        self.staged = {}


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], order: str) -> None:
    """One upsert as a transaction of its own."""
    with Transaction(spark) as t:
        t.upsert(new, path, keys, order)


def clear(spark: SparkSession, path: str) -> None:
    """The table at path is gone; other files beside it stay."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], fingerprint: str = "") -> DataFrame:
    """A phase's table; built once, and again where the fingerprint of its inputs and settings has changed."""
    if not exists(spark, path + "/_SUCCESS") or (get_text(spark, path + "/_fingerprint") or "") != fingerprint:
        build().write.mode("overwrite").parquet(path)
        put_text(spark, path + "/_fingerprint", fingerprint)
    return spark.read.parquet(path)


def staged_import(spark: SparkSession, root: str, phases: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], settings: str = "") -> dict[str, DataFrame]:
    """Phases in order, each a table built from the ones before it; a phase whose settings or predecessors have changed
    is built again, and so are all behind it."""
    done: dict[str, DataFrame] = {}
    mark = settings
    for name, build in phases:
        mark = hashlib.sha256(f"{mark}/{name}".encode()).hexdigest()[:16]
        done[name] = stage(spark, f"{root}/{name}", lambda build=build: build(done), mark)
    return done


def latest_run(spark: SparkSession, root: str, prefix: str, dataset: str | None = None) -> str | None:
    """The newest folder prefix_[dataset_]* under root/runs or root; None if there is none."""
    head = f"{prefix}_{dataset}_" if dataset else f"{prefix}_"
    found = []
    for place in (f"{root}/runs", root):
        if exists(spark, place):
            fs, p = fs_of(spark, place)
            found += [(f.getModificationTime(), f.getPath().toString()) for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName().startswith(head)]
    return max(found)[1] if found else None


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, one folder per configuration."""
    records.write.mode("append").partitionBy("row_name").json(path)


def write_summary(rows: DataFrame, path: str, limit: int = 1000) -> str:
    """The small summary table as CSV below path and as a Markdown text (returned)."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    head = rows.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines)


def latex_table(rows: DataFrame, limit: int = 1000) -> str:
    """The summary as a LaTeX tabular."""
    clean = lambda v: "" if v is None else latex_escape(str(v))
    head = " & ".join(clean(c) for c in rows.columns)
    body = [" & ".join(clean(v) for v in r) + r" \\" for r in rows.limit(limit).collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", head + r" \\ \hline", *body, r"\end{tabular}"])


def latex_escape(text: str) -> str:
    """Text with the letters that LaTeX reserves escaped."""
    return "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}"}.get(c, c) for c in text)


def without_cached(texts: DataFrame, cache: DataFrame, key: str, model: str) -> DataFrame:
    """Texts whose (hash, model) the cache lacks, with their hash."""
    keyed = texts.withColumn("text_hash", F.sha2(F.col(key), 256))
    return keyed.join(cache.where(F.col("model") == model).select("text_hash"), "text_hash", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    """E19."""
    return cache.groupBy("model").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("access_count").alias("n_accesses"))
