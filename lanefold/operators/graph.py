"""The entity graph as tables: building, quality, cleanup, duplicate merging, traversal and the graph lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.functions.text import canonical_form, canonical_sql, short_hash, strip, strip_sql
from lanefold.operators.skew import attach_counted, numbered
from lanefold.sources.shared import load, materialise

#: Hub cap at retrieval, minimum confidence and entities a chunk of co-occurrence, hub rule of cleanup,
#: preview length, limits of the baseline invariants.
HUB_MENTIONS, MIN_CONFIDENCE, PER_CHUNK, HUB_MIN, HUB_SHARE, PREVIEW = 280, 0.5, 30, 50, 0.03, 500
MAX_ISOLATED, MAX_DUPLICATE, MIN_RELATIONS = 0.05, 0.02, 5.0
#: Entity names that are dropped, and query terms that are no graph keys.
STOPLIST = (
    "he she they it we i you him her his hers us them their theirs this that these those american british english german french "
    "italian spanish japanese chinese russian australian canadian european asian african indian korean mexican brazilian polish irish "
    "scottish welsh dutch swedish norwegian danish greek turkish arab arabic swiss austrian belgian u.s. uk u.k."
).split()
NO_KEYS = (
    "american british english irish italian french german spanish russian chinese japanese canadian australian scottish welsh dutch "
    "swedish norwegian danish polish european asian african indian mexican brazilian physics chemistry biology mathematics history "
    "science music art film movie book novel band album song writer actor director singer physicist scientist author what which who "
    "whom whose where when why how"
).split() + ["what year", "which year", "what city", "what country", "the same"]


# --- nodes and edges ------------------------------------------------------------------------------------------------


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per chunk, with a text preview."""
    c = load(spark, sf_dir, "chunk_extractions").where(F.col("chunk_id").isNotNull())
    return c.groupBy("chunk_id").agg(F.max("source_file").alias("source_file"), F.max(F.substring("text", 1, PREVIEW)).alias("text"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per entity_id; of several records the most confident, then the greatest name."""
    cols = ["entity_id", "name", "entity_type", "confidence"]
    both = load(spark, sf_dir, "extracted_entities").select(*cols).unionByName(load(spark, sf_dir, "gazetteer").select(*cols))
    best = F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("name"), F.col("entity_type")))
    return both.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(best.alias("x")).select("entity_id", "x.name", "x.entity_type", "x.confidence")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunk to entity edges whose entity is a node."""
    m = load(spark, sf_dir, "mentions").where(F.col("chunk_id").isNotNull() & F.col("entity_id").isNotNull()).select("chunk_id", "entity_id").distinct()
    return attach_counted(m, entities(spark, sf_dir).select("entity_id"), "entity_id").select("chunk_id", "entity_id")


def mention_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, n): distinct mention edges of every node that has any; counted before nodes are looked up, so nothing is hot."""
    m = load(spark, sf_dir, "mentions").where(F.col("chunk_id").isNotNull() & F.col("entity_id").isNotNull()).select("chunk_id", "entity_id").distinct()
    return m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).join(entities(spark, sf_dir).select("entity_id"), "entity_id", "left_semi")


def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (chunk_id, entity_id) of the extraction lists, with the best confidence and a name."""
    c = load(spark, sf_dir, "chunk_extractions").where(F.col("chunk_id").isNotNull()).select("chunk_id", F.explode("entities").alias("e"))
    return c.where(F.col("e.entity_id").isNotNull()).groupBy("chunk_id", F.col("e.entity_id").alias("entity_id")).agg(F.max("e.confidence").alias("confidence"), F.min("e.name").alias("name"))


def names_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, entity_id): the smallest id of each lower-cased name of the extraction lists."""
    ce = load(spark, sf_dir, "chunk_extractions").select(F.explode("entities").alias("e")).select("e.entity_id", "e.name").distinct()
    return ce.where(F.col("entity_id").isNotNull() & (strip(F.coalesce("name", F.lit(""))) != "")).groupBy(F.lower(strip(F.col("name"))).alias("key")).agg(F.min("entity_id").alias("entity_id"))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, relation_type, dst, confidence, n_chunks) of the extracted triples.

    Both ends are resolved by lower-cased name, unresolved triples and self-loops are dropped, one edge per (src, type,
    dst) keeps the best confidence and counts its chunks.
    """
    r = load(spark, sf_dir, "chunk_extractions").where(F.col("chunk_id").isNotNull()).select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", "r.subject_entity", "r.relation_type", "r.object_entity", "r.confidence")
    ids = names_to_ids(spark, sf_dir)
    s = ids.select(F.col("key").alias("s_key"), F.col("entity_id").alias("src"))
    o = ids.select(F.col("key").alias("o_key"), F.col("entity_id").alias("dst"))
    r = r.join(s, F.lower(strip(F.col("subject_entity"))) == F.col("s_key")).join(o, F.lower(strip(F.col("object_entity"))) == F.col("o_key"))
    return r.where(F.col("src") != F.col("dst")).groupBy("src", "relation_type", "dst").agg(F.max("confidence").alias("confidence"), F.countDistinct("chunk_id").alias("n_chunks"))


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs (a < b) of a chunk's at most PER_CHUNK most confident entities, each pair once."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("confidence"), "entity_id")
    kept = chunk_entities(spark, sf_dir).where(F.col("confidence") >= MIN_CONFIDENCE).withColumn("i", F.row_number().over(w)).where(F.col("i") <= PER_CHUNK)
    lists = kept.groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity_id")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice(F.col("e"), i + 2, F.size("e")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select("chunk_id", F.inline(pairs)).groupBy("a", "b").agg(F.min("chunk_id").alias("source_chunk"), F.count(F.lit(1)).alias("n_chunks"))


def unordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def next_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's place in its source file and the chunk that follows; sources of any size are spread."""
    c = chunks(spark, sf_dir).where(F.col("source_file").isNotNull()).select("chunk_id", "source_file")
    placed = materialise(numbered(c, ["source_file"], {"_c": F.col("chunk_id")}).select("chunk_id", "source_file", F.col("_place").alias("place")), "chunk-places")
    follows = placed.select("source_file", (F.col("place") - 1).alias("place"), F.col("chunk_id").alias("next_chunk_id"))
    return placed.join(follows, ["source_file", "place"], "left")


def w04_chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


def w05_source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(F.col("source_file").isNotNull()).groupBy("source_file").agg(F.count(F.lit(1)).alias("total_chunks"))


def w06_entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


def w09_next_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_chunk(spark, sf_dir).select("source_file", "place", "chunk_id", "next_chunk_id")


def w10_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir)


def w22_related_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


def g11_context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at most two steps along NEXT_CHUNK from each chunk, with their distance."""
    p = next_chunk(spark, sf_dir).select("source_file", "place", "chunk_id")
    near = p.select("source_file", F.col("chunk_id").alias("start"), F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])).alias("step"), "place").withColumn("place", F.col("place") + F.col("step"))
    return near.join(p, ["source_file", "place"]).select("start", "chunk_id", F.abs("step").alias("hops"))


# --- quality and cleanup --------------------------------------------------------------------------------------------


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of an edge."""
    ends = edges.select(F.col("src").alias("entity_id")).unionByName(edges.select(F.col("dst").alias("entity_id"))).distinct()
    return nodes.join(ends, "entity_id", "left_anti")


def keepers(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(entity_id, keeper, size) of nodes that share canonical form and type with others.

    The keeper has most mentions (``degree``: entity_id, n), then the shortest name, then the smallest id; it is found by
    aggregation.
    """
    d = nodes.join(degree, "entity_id", "left").withColumn("canon", canonical_form(F.col("name"))).where(F.col("canon") != "")
    pick = F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), F.length("name").alias("len"), F.col("entity_id").alias("keeper")))
    g = d.groupBy("canon", "entity_type").agg(pick["keeper"].alias("keeper"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return d.join(g, ["canon", "entity_type"]).select("entity_id", "keeper", "size", "canon", "entity_type")


def redirect(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends sent to their keepers; self-loops dropped, one edge per (src, type, dst)."""
    m = keep.select("entity_id", "keeper")
    s, d = m.select(F.col("entity_id").alias("src"), F.col("keeper").alias("ks")), m.select(F.col("entity_id").alias("dst"), F.col("keeper").alias("kd"))
    r = edges.join(s, "src", "left").join(d, "dst", "left").withColumn("src", F.coalesce("ks", "src")).withColumn("dst", F.coalesce("kd", "dst"))
    return r.where(F.col("src") != F.col("dst")).groupBy("src", "relation_type", "dst").agg(F.max("confidence").alias("confidence"), F.sum("n_chunks").alias("n_chunks"))


def g04_hub_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with more than HUB_MENTIONS mention edges."""
    return mention_degrees(spark, sf_dir).join(entities(spark, sf_dir).select("entity_id", "name"), "entity_id").groupBy("name").agg(F.sum("n").alias("n_mentions")).where(F.col("n_mentions") > HUB_MENTIONS)


def worthy(c: Column) -> Column:
    """G05."""
    s = strip(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(F.replace(F.lower(s), F.lit(",")), r"s+$", "")
    return (F.length(s) >= 3) & ~F.lower(s).isin(NO_KEYS) & ~bare.rlike(r"^\d+$")


def g05_graph_worthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("entity_id", worthy(F.col("name")).alias("worthy"))


def relation_weight(c: Column) -> Column:
    """Cooccurs 0.25, several words 1, a single word 0.6."""
    r = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(r == "", 1.0).when(r == "cooccurs", 0.25).when(r.contains("_") | r.contains(" "), 1.0).otherwise(0.6)


def with_support(edges: DataFrame, ce: DataFrame) -> DataFrame:
    """Edges with n_support, the chunks that name both ends, and triple_confidence.

    An edge is worked from the end in fewer chunks: its chunks are looked up, and those that name the other end counted. So
    work is the sum of the smaller degrees, and no pairs of a chunk's entities are formed.
    """
    ce = ce.select("chunk_id", "entity_id").distinct()
    degree = ce.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select(*unordered("src", "dst")).distinct()
    for end in "ab":
        ends = ends.join(degree.select(F.col("entity_id").alias(end), F.col("n").alias(f"n_{end}")), end)
    fewer = F.col("n_a") <= F.col("n_b")
    ends = ends.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("entity_id"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    named = ends.join(ce, "entity_id").select("a", "b", "chunk_id", F.col("other").alias("entity_id"))
    support = named.join(ce, ["chunk_id", "entity_id"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_support"))
    e = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(support, ["a", "b"], "left").drop("a", "b")
    n, w = F.coalesce("n_support", F.lit(0)), relation_weight(F.col("relation_type"))
    return e.withColumn("n_support", n).withColumn("triple_confidence", F.round(F.when(n <= 0, 0.3 * w).otherwise(F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(10.0))) * w), 6))


def g06_triple_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_support(related(spark, sf_dir), chunk_entities(spark, sf_dir)).select("src", "relation_type", "dst", "n_support", "triple_confidence")


def g13_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = next_chunk(spark, sf_dir)
    parts = {"document_chunks": chunks(spark, sf_dir), "source_documents": w05_source_nodes(spark, sf_dir), "entities": entities(spark, sf_dir), "from_source_edges": c, "next_chunk_edges": c.where(F.col("next_chunk_id").isNotNull()), "mentions_edges": None, "related_to_edges": related(spark, sf_dir)}
    out = None
    for name, df in parts.items():
        n = mention_degrees(spark, sf_dir).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")) if df is None else df.agg(F.count(F.lit(1)).alias("n"))
        row = n.select(F.lit(name).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def g14_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_edges(spark, sf_dir)


def g15_unsubsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurrence pairs without a semantic edge in either direction."""
    semantic = related(spark, sf_dir).select(*unordered("src", "dst")).distinct()
    return cooccurrence_edges(spark, sf_dir).join(semantic, ["a", "b"], "left_anti").select("a", "b")


def dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, reason) of nodes that cleanup removes: stop list, then orphans, then hubs."""
    nodes, degree = entities(spark, sf_dir), mention_degrees(spark, sf_dir)
    n_chunks = chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_all"))
    d = nodes.join(degree, "entity_id", "left").crossJoin(F.broadcast(n_chunks))
    reason = F.when(canonical_form(F.col("name")).isin(STOPLIST), "stoplist").when(F.col("n").isNull(), "orphan").when(F.col("n") > F.greatest(F.lit(HUB_MIN), F.col("n_all") * HUB_SHARE), "hub")
    return d.select("entity_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def g16_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped(spark, sf_dir)


def g20_duplicate_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keepers(entities(spark, sf_dir), mention_degrees(spark, sf_dir)).select("entity_id", "keeper", "size")


def g22_redirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirect(related(spark, sf_dir), keepers(entities(spark, sf_dir), mention_degrees(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


def g25_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolated(entities(spark, sf_dir), related(spark, sf_dir)).select("entity_id", "entity_type")


def g26_without_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type left after the isolated ones are deleted, and their mention edges."""
    e = entities(spark, sf_dir)
    left = e.join(isolated(e, related(spark, sf_dir)).select("entity_id"), "entity_id", "left_anti")
    n = mention_degrees(spark, sf_dir)
    return left.join(n, "entity_id", "left").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_mentions"))


def g27_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 largest clusters of one canonical form and type."""
    k = keepers(entities(spark, sf_dir), mention_degrees(spark, sf_dir)).groupBy("canon", "entity_type").agg(F.max("size").alias("size"), F.min("entity_id").alias("first_id"))
    return k.orderBy(F.desc("size"), "canon", "entity_type").limit(100)


def g28_top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 entities in most chunks."""
    n = mention_degrees(spark, sf_dir).withColumnRenamed("n", "n_chunks")
    return n.orderBy(F.desc("n_chunks"), "entity_id").limit(20)


def g29_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, densities, isolated and duplicate rates, and the invariants they break."""
    nodes, m, r = entities(spark, sf_dir), mention_degrees(spark, sf_dir), related(spark, sf_dir)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    k = keepers(nodes, m)
    row = one(chunks(spark, sf_dir), "chunks").crossJoin(one(nodes, "entities")).crossJoin(m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))).crossJoin(one(r, "relations")).crossJoin(one(isolated(nodes, r), "isolated"))
    row = row.crossJoin(k.agg(F.count(F.lit(1)).alias("in_clusters"), F.countDistinct("keeper").alias("clusters")))
    per = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 6)
    row = row.withColumn("duplicates", F.col("in_clusters") - F.col("clusters")).withColumns({
        "entities_per_chunk": per("entities", "chunks"), "mentions_per_chunk": per("mentions", "chunks"), "relations_per_chunk": per("relations", "chunks"), "isolated_rate": per("isolated", "entities"), "duplicate_rate": per("duplicates", "entities"),
    })
    broken = F.concat_ws(",", F.when(F.col("isolated_rate") > MAX_ISOLATED, "isolated_rate"), F.when(F.col("duplicate_rate") > MAX_DUPLICATE, "duplicate_rate"), F.when(F.col("relations_per_chunk") < MIN_RELATIONS, "relations_per_chunk"))
    return row.withColumn("violations", broken).drop("in_clusters")


def g33_edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2000 edges for plotting, the most supported ones."""
    return related(spark, sf_dir).select("src", "relation_type", "dst", "n_chunks").orderBy(F.desc("n_chunks"), "src", "relation_type", "dst").limit(2000)


# --- lookup and traversal -------------------------------------------------------------------------------------------


def name_variants(c: Column) -> Column:
    """The name, its last word of four letters or more, and its other words of seven or more."""
    t = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    last = F.filter(F.slice(t, -1, 1), lambda x: F.length(x) >= 4)
    others = F.filter(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1))), lambda x: F.length(x) >= 7)
    return F.when(F.size(t) < 2, F.array(c)).otherwise(F.array_distinct(F.concat(F.array(c), last, others)))


def g02_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where(F.col("name").isNotNull())
    return e.select("entity_id", F.posexplode(name_variants(strip(F.col("name"))))).select("entity_id", F.col("pos").alias("priority"), F.col("col").alias("variant"))


def subphrases(c: Column) -> Column:
    """Distinct runs of two words or more, longest first (then alphabetic), at most 20, of four letters or more."""
    t = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    runs = F.flatten(F.transform(t, lambda _, i: F.transform(F.sequence(F.lit(2), F.greatest(F.size(t), F.lit(2))), lambda n: F.when(i + n <= F.size(t), F.concat_ws(" ", F.slice(t, i + 1, n))))))
    good = F.array_distinct(F.filter(runs, lambda s: s.isNotNull() & (F.length(s) >= 4)))
    order = F.array_sort(F.transform(good, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    return F.slice(F.transform(order, lambda x: x["s"]), 1, 20)


def g03_subphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).where(F.col("name").isNotNull())
    return e.select("entity_id", F.posexplode(subphrases(strip(F.col("name"))))).select("entity_id", F.col("pos").alias("priority"), F.col("col").alias("phrase"))


def containing(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name): names that contain the key as a substring, found through the key's rarest three letters.

    Every name that contains a key of three letters or more has all of its trigrams, so the join on one of them loses
    nothing and needs no nested loop; keys shorter than that are left out.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))
    by_gram = names.where(F.length("name") >= 3).select("name", F.explode(grams("name")).alias("gram"))
    counts = by_gram.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    k = keys.where(F.length("key") >= 3).select("key", F.explode(grams("key")).alias("gram")).join(counts, "gram", "left")
    k = k.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram")))["gram"].alias("gram"))
    return k.join(by_gram, "gram").where(F.col("name").contains(F.col("key"))).select("key", "name")


def lookup(keys: DataFrame, names: DataFrame) -> DataFrame:
    """G01, first hop: (key, name, stage): names equal to the key (0), else containing it (1), else its sub-phrases (2)."""
    exact = keys.join(names, F.col("key") == F.col("name")).select("key", "name", F.lit(0).alias("stage"))
    inside = containing(keys, names).select("key", "name", F.lit(1).alias("stage"))
    parts = keys.select("key", F.explode(subphrases(F.col("key"))).alias("name")).join(names, "name").select("key", "name", F.lit(2).alias("stage"))
    found = exact.unionByName(inside).unionByName(parts)
    best = found.groupBy("key").agg(F.min("stage").alias("stage"))
    return found.join(best, ["key", "stage"]).select("key", "name", "stage").distinct()


def question_entities(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """(query_id, key): capitalised runs of more than two letters and quoted strings, junk-free, once each."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"([\p{Lu}][\p{L}&'-]+(?:\s+[\p{Lu}][\p{L}&'-]+)*)"), F.lit(1))
    quoted = F.regexp_extract_all(F.col(text), F.lit('"([^"]+)"'), F.lit(1))
    keys = F.array_union(F.filter(runs, lambda x: F.length(x) > 2), quoted)
    e = questions.where(F.col(text).isNotNull()).select(F.col(qid).alias("query_id"), F.explode(keys).alias("key"))
    return e.where(worthy(F.col("key"))).distinct()


def e27_question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = load(spark, sf_dir, "agentic_ablation").select("question_id", "question").distinct()
    return question_entities(q, "question_id", "question")


def start_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, entity_id, matched): the entities whose names ``lookup`` finds for each query's keys."""
    hit = lookup(queries.select("key").distinct(), names.select("name").distinct()).join(names, "name").select("key", "name", "entity_id")
    return queries.join(hit, "key").select("query_id", "entity_id", F.col("name").alias("matched")).distinct()


def graph_lane(start: DataFrame, names: DataFrame, edges: DataFrame, m: DataFrame, hubs: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, hops, matched, confidence, rank) of each query's start entities.

    Hop 0: chunks of the start entities. Hop 2: chunks of entities one RELATED_TO edge (either direction) away, hub names
    left out, with the best triple confidence. A chunk keeps its fewest hops; the k best by hops, confidence and chunk id
    are ranked. ``edges`` have triple_confidence; ``m``: each entity's k first chunks, as no later one can be among the k
    best of a query: the entity's first k come before it with the same hops and confidence, or are there with fewer hops.
    """
    hop0 = start.join(m, "entity_id").select("query_id", "chunk_id", F.lit(0).alias("hops"), "matched", F.lit(1.0).alias("confidence"))
    both = edges.select("src", "dst", "triple_confidence").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "triple_confidence"))
    both = both.groupBy("src", "dst").agg(F.max("triple_confidence").alias("confidence"))
    bridge = names.join(hubs.select("name"), "name", "left_anti").select(F.col("entity_id").alias("dst"))
    step = start.join(both, F.col("entity_id") == F.col("src")).join(bridge, "dst").groupBy("query_id", "dst").agg(F.max("confidence").alias("confidence"), F.min("matched").alias("matched"))
    hop2 = step.join(m, F.col("dst") == F.col("entity_id")).select("query_id", "chunk_id", F.lit(2).alias("hops"), "matched", "confidence")
    best = hop0.unionByName(hop2).groupBy("query_id", "chunk_id").agg(F.min(F.struct("hops", (-F.col("confidence")).alias("c"), "matched")).alias("x"))
    w = Window.partitionBy("query_id").orderBy("hops", F.desc("confidence"), "chunk_id")
    best = best.select("query_id", "chunk_id", "x.hops", "x.matched", (-F.col("x.c")).alias("confidence"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_chunks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Each mentioned entity's k first chunk ids; the window keeps k rows an entity before the shuffle."""
    m = load(spark, sf_dir, "mentions").where(F.col("chunk_id").isNotNull() & F.col("entity_id").isNotNull()).select("chunk_id", "entity_id").distinct()
    w = Window.partitionBy("entity_id").orderBy("chunk_id")
    return m.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).select("chunk_id", "entity_id")


def g08_graph_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = materialise(entities(spark, sf_dir).where(F.col("name").isNotNull()).select("entity_id", "name"), "names")
    start = materialise(start_entities(e27_question_entities(spark, sf_dir), names), "start-entities")
    wanted = start.select("entity_id").distinct()
    edges = materialise(related(spark, sf_dir), "triples")
    touched = edges.join(wanted.withColumnRenamed("entity_id", "src"), "src", "left_semi").unionByName(edges.join(wanted.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")).distinct()
    return graph_lane(start, names, with_support(touched, chunk_entities(spark, sf_dir)), first_chunks(spark, sf_dir, 5), g04_hub_names(spark, sf_dir))


def bfs(starts: DataFrame, edges: DataFrame, max_hops: int, directed: bool = False) -> DataFrame:
    """(start, entity_id, hops): nodes within max_hops steps, with the fewest steps; the start has 0. Edges are walked both
    ways unless ``directed``."""
    out = edges.select("src", "dst")
    both = materialise((out if directed else out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct(), "adjacent")
    seen = starts.select(F.col("entity_id").alias("start"), "entity_id", F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, max_hops + 1):
        step = front.join(both, F.col("entity_id") == F.col("src")).select("start", F.col("dst").alias("entity_id")).distinct()
        front = materialise(step.join(seen, ["start", "entity_id"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(front)
    return seen


def g09_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps of every gazetteer entity."""
    return bfs(load(spark, sf_dir, "gazetteer").select("entity_id"), related(spark, sf_dir), 2)


def w08_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge from every chunk to its source document."""
    return chunks(spark, sf_dir).where(F.col("source_file").isNotNull()).select("chunk_id", "source_file")


def g09_chunk_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G09 from a chunk, directed: chunks within two NEXT_CHUNK steps behind every first chunk of a source."""
    p = next_chunk(spark, sf_dir)
    edges = p.where(F.col("next_chunk_id").isNotNull()).select(F.col("chunk_id").alias("src"), F.col("next_chunk_id").alias("dst"))
    return bfs(p.where(F.col("place") == 1).select(F.col("chunk_id").alias("entity_id")), edges, 2, directed=True).withColumnRenamed("entity_id", "chunk_id")


def canonical_graph(spark: SparkSession, sf_dir: str, least: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, mentions, triples) built from extractions alone, with ids from canonical form and type.

    Entities under the confidence are left out; mentions are distinct; both ends of a triple are resolved by lower-cased
    name (the smallest id where a name has several), unresolved triples and self-loops dropped, repeated ones once.
    """
    c = load(spark, sf_dir, "chunk_extractions").where(F.col("chunk_id").isNotNull())
    e = c.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", "e.name", "e.entity_type", "e.confidence").where((F.col("confidence") >= least) & F.col("name").isNotNull() & F.col("entity_type").isNotNull())
    canon = canonical_form(F.col("name"))
    e = e.withColumn("canon", canon).where(F.col("canon") != "").withColumn("entity_id", short_hash(F.concat("canon", F.lit(":"), "entity_type"), 24))
    nodes = e.groupBy("entity_id").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"), F.max("confidence").alias("confidence"))
    ids = e.groupBy(F.lower(strip(F.col("name"))).alias("key")).agg(F.min("entity_id").alias("id"))
    r = c.select("chunk_id", F.explode("relations").alias("r")).select("r.subject_entity", "r.relation_type", "r.object_entity", "r.confidence")
    s, o = ids.select(F.col("key").alias("s_key"), F.col("id").alias("src")), ids.select(F.col("key").alias("o_key"), F.col("id").alias("dst"))
    r = r.join(s, F.lower(strip(F.col("subject_entity"))) == F.col("s_key")).join(o, F.lower(strip(F.col("object_entity"))) == F.col("o_key")).where(F.col("src") != F.col("dst"))
    return nodes, e.select("chunk_id", "entity_id").distinct(), r.groupBy("src", "relation_type", "dst").agg(F.max("confidence").alias("confidence"))


def w25_canonical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, m, _ = canonical_graph(spark, sf_dir)
    n = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return nodes.join(n, "entity_id").withColumn("confidence", F.round("confidence", 6))


def w25_canonical_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_graph(spark, sf_dir)[2].withColumn("confidence", F.round("confidence", 6))


def g32_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, mention edges and related pairs of every entity type, most entities first by the reader's sort."""
    e, r = entities(spark, sf_dir), related(spark, sf_dir)
    kind = e.select("entity_id", "entity_type")
    per = e.join(mention_degrees(spark, sf_dir), "entity_id", "left").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_mentions"))
    out = r.groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("n")).join(kind, "entity_id").groupBy("entity_type").agg(F.sum("n").alias("n_relations"))
    return per.join(out, "entity_type", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))


def baseline_report(metrics: DataFrame) -> str:
    """The one-row baseline as text, one line a measure, invariants last."""
    row = metrics.first().asDict()
    lines = [f"{k.replace('_', ' ')}: {v}" for k, v in row.items() if k != "violations"]
    return "\n".join(["graph baseline", *lines, f"invariants broken: {row['violations'] or 'none'}"])


QUERIES = {f.__name__: f for f in (
    w08_from_source, w25_canonical_nodes, w25_canonical_triples, g09_chunk_walk, g32_inspect,
    w04_chunk_nodes, w05_source_nodes, w06_entity_nodes, w09_next_chunk, w10_mentions, w22_related_to, g02_name_variants, g03_subphrases, g04_hub_names, g05_graph_worthy, g06_triple_confidence, g08_graph_lane, g09_traversal,
    g11_context_chunks, g13_statistics, g14_cooccurrence, g15_unsubsumed, g16_cleanup, g20_duplicate_keepers, g22_redirected, g25_isolated, g26_without_isolated, g27_duplicate_clusters, g28_top_entities, g29_baseline, g33_edge_sample, e27_question_entities,
)}

_NO = ", ".join(f"'{x}'" for x in NO_KEYS)
_S = strip_sql
_G = f"""WITH RECURSIVE ch AS (SELECT chunk_id, max(source_file) AS source_file, max(substring(text, 1, 500)) AS text FROM chunk_extractions WHERE chunk_id IS NOT NULL GROUP BY 1),
    un AS (SELECT entity_id, name, entity_type, coalesce(confidence, 0) AS confidence FROM extracted_entities UNION ALL SELECT entity_id, name, entity_type, coalesce(confidence, 0) FROM gazetteer),
    en AS (SELECT entity_id, name, entity_type, confidence FROM un WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, name DESC, entity_type DESC) = 1),
    me AS (SELECT DISTINCT chunk_id, entity_id FROM mentions WHERE chunk_id IS NOT NULL AND entity_id IN (SELECT entity_id FROM en)),
    ex AS (SELECT chunk_id, unnest(entities) AS e FROM chunk_extractions),
    ce AS (SELECT chunk_id, e.entity_id AS entity_id, max(e.confidence) AS confidence FROM ex WHERE e.entity_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
    ids AS (SELECT lower({_S('e.name')}) AS key, min(e.entity_id) AS entity_id FROM ex WHERE e.entity_id IS NOT NULL AND {_S("coalesce(e.name, '')")} <> '' GROUP BY 1),
    rx AS (SELECT chunk_id, unnest(relations) AS r FROM chunk_extractions WHERE chunk_id IS NOT NULL),
    re AS (SELECT s.entity_id AS src, r.relation_type AS relation_type, o.entity_id AS dst, max(r.confidence) AS confidence, count(DISTINCT chunk_id) AS n_chunks
        FROM rx JOIN ids s ON lower({_S('r.subject_entity')}) = s.key JOIN ids o ON lower({_S('r.object_entity')}) = o.key WHERE s.entity_id <> o.entity_id GROUP BY 1, 2, 3),
    nx AS (SELECT chunk_id, source_file, row_number() OVER w AS place, lead(chunk_id) OVER w AS next_chunk_id FROM ch WHERE source_file IS NOT NULL WINDOW w AS (PARTITION BY source_file ORDER BY chunk_id)),
    ck AS (SELECT chunk_id, entity_id FROM ce WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, entity_id) <= 30),
    co AS (SELECT x.entity_id AS a, y.entity_id AS b, min(x.chunk_id) AS source_chunk, count(*) AS n_chunks FROM ck x JOIN ck y ON x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id GROUP BY 1, 2),
    dg AS (SELECT entity_id, count(*) AS n FROM me GROUP BY 1),
    cf AS (SELECT en.*, coalesce(n, 0) AS n, n IS NULL AS lone, {canonical_sql('name')} AS canon FROM en LEFT JOIN dg USING (entity_id)),
    ke AS (SELECT entity_id, canon, entity_type, first_value(entity_id) OVER (PARTITION BY canon, entity_type ORDER BY n DESC, length(name), entity_id) AS keeper, count(*) OVER (PARTITION BY canon, entity_type) AS size FROM cf WHERE canon <> '' AND entity_type IS NOT NULL QUALIFY size > 1),
    iso AS (SELECT * FROM en WHERE entity_id NOT IN (SELECT src FROM re UNION SELECT dst FROM re)),
    hub AS (SELECT name, count(*) AS n_mentions FROM me JOIN en USING (entity_id) GROUP BY 1 HAVING count(*) > 280),
    su AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM ce x JOIN ce y ON x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id GROUP BY 1, 2),
    rw AS (SELECT re.*, coalesce(su.n, 0) AS n_support, CASE WHEN lower(relation_type) = 'cooccurs' THEN 0.25 WHEN contains(relation_type, ' ') OR contains(relation_type, '_') OR relation_type = '' THEN 1 ELSE 0.6 END::DOUBLE AS w FROM re LEFT JOIN su ON su.a = least(src, dst) AND su.b = greatest(src, dst)),
    tc AS (SELECT *, round(CASE WHEN n_support <= 0 THEN 0.3::DOUBLE * w ELSE least(1, ln(1 + n_support) / ln(10)) * w END, 6) AS triple_confidence FROM rw)"""
_QE = f"""qq AS (SELECT DISTINCT question_id, question FROM agentic_ablation WHERE question IS NOT NULL),
    qk AS (SELECT DISTINCT question_id AS query_id, key FROM (SELECT question_id, unnest(list_concat(list_filter(regexp_extract_all(question, '[\\p{{Lu}}][\\p{{L}}&''-]+(?:\\s+[\\p{{Lu}}][\\p{{L}}&''-]+)*'), lambda x: length(x) > 2), regexp_extract_all(question, '"([^"]+)"', 1))) AS key FROM qq)
        WHERE length({_S('key')}) >= 3 AND lower({_S('key')}) NOT IN ({_NO}) AND NOT regexp_matches(regexp_replace(replace(lower({_S('key')}), ',', ''), 's+$', ''), '^[0-9]+$'))"""
_CG = f""", cg AS (SELECT chunk_id, name, entity_type, confidence, lower({_S('name')}) AS key, substring(sha256({canonical_sql('name')} || ':' || entity_type), 1, 24) AS entity_id FROM (SELECT chunk_id, e.name AS name, e.entity_type AS entity_type, e.confidence AS confidence FROM ex WHERE chunk_id IS NOT NULL) WHERE confidence >= 0.5 AND name IS NOT NULL AND entity_type IS NOT NULL AND {canonical_sql('name')} <> ''),
    ci AS (SELECT key, min(entity_id) AS id FROM cg GROUP BY 1)"""
#: CTE lo: (key, name) by the lookup's stages.
_LOOKUP = """, ks AS (SELECT DISTINCT key FROM qk), nm AS (SELECT DISTINCT name FROM en WHERE name IS NOT NULL),
        kz AS (SELECT key, list_filter(regexp_split_to_array(key, '\\s+'), lambda x: x <> '') AS t FROM ks), ki AS (SELECT key, t, unnest(range(1, len(t))) AS i FROM kz), kj AS (SELECT key, t, i, unnest(range(i + 1, len(t) + 1)) AS j FROM ki),
        kp AS (SELECT key, array_to_string(t[i:j], ' ') AS p FROM kj), kq AS (SELECT DISTINCT key, p FROM kp WHERE length(p) >= 4), kr AS (SELECT key, p FROM kq QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(p) DESC, p) <= 20),
        fo AS (SELECT key, name, 0 AS stage FROM ks JOIN nm ON key = name UNION ALL SELECT key, name, 1 FROM ks JOIN nm ON contains(name, key) UNION ALL SELECT key, name, 2 FROM kr JOIN nm ON p = name),
        lo AS (SELECT DISTINCT key, name FROM fo QUALIFY stage = min(stage) OVER (PARTITION BY key))"""
_TOKS = f"list_filter(regexp_split_to_array({_S('name')}, '\\s+'), lambda x: x <> '')"
ORACLE = {
    "w04_chunk_nodes": _G + " SELECT * FROM ch",
    "w05_source_nodes": _G + " SELECT source_file, count(*) AS total_chunks FROM ch WHERE source_file IS NOT NULL GROUP BY 1",
    "w06_entity_nodes": _G + " SELECT entity_id, name, entity_type, round(confidence, 6) AS confidence FROM en",
    "w08_from_source": _G + " SELECT chunk_id, source_file FROM ch WHERE source_file IS NOT NULL",
    "w25_canonical_nodes": _G + _CG + " SELECT entity_id, min(name) AS name, min(entity_type) AS entity_type, round(max(confidence), 6) AS confidence, count(DISTINCT chunk_id) AS n_chunks FROM cg GROUP BY 1",
    "w25_canonical_triples": _G + _CG + f" SELECT s.id AS src, r.relation_type AS relation_type, o.id AS dst, round(max(r.confidence), 6) AS confidence FROM rx JOIN ci s ON lower({_S('r.subject_entity')}) = s.key JOIN ci o ON lower({_S('r.object_entity')}) = o.key WHERE s.id <> o.id GROUP BY 1, 2, 3",
    "g09_chunk_walk": _G + " SELECT x.chunk_id AS start, y.chunk_id, (y.place - 1)::INT AS hops FROM nx x JOIN nx y ON x.source_file = y.source_file WHERE x.place = 1 AND y.place <= 3",
    "g32_inspect": _G + ", rn AS (SELECT src AS entity_id, count(*) AS n FROM re GROUP BY 1) SELECT entity_type, count(*) AS n_entities, coalesce(sum(dg.n), 0)::BIGINT AS n_mentions, coalesce(sum(rn.n), 0)::BIGINT AS n_relations FROM en LEFT JOIN dg USING (entity_id) LEFT JOIN rn USING (entity_id) GROUP BY 1",
    "w09_next_chunk": _G + " SELECT source_file, place, chunk_id, next_chunk_id FROM nx",
    "w10_mentions": _G + " SELECT * FROM me",
    "w22_related_to": _G + " SELECT src, relation_type, dst, round(confidence, 6) AS confidence, n_chunks FROM re",
    "g02_name_variants": _G + f""", t AS (SELECT entity_id, {_S('name')} AS name, {_TOKS} AS t FROM en WHERE name IS NOT NULL),
        v AS (SELECT entity_id, CASE WHEN len(t) < 2 THEN [name] ELSE list_concat([name], list_filter(t[-1:], lambda x: length(x) >= 4), list_filter(t[:-2], lambda x: length(x) >= 7)) END AS v FROM t),
        u AS (SELECT entity_id, unnest(v) AS variant, generate_subscripts(v, 1) AS i FROM v), f AS (SELECT entity_id, variant, min(i) AS i FROM u GROUP BY 1, 2)
        SELECT entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY i) - 1)::INT AS priority, variant FROM f""",
    "g03_subphrases": _G + f""", t AS (SELECT entity_id, {_TOKS} AS t FROM en WHERE name IS NOT NULL), i AS (SELECT entity_id, t, unnest(range(1, len(t))) AS i FROM t), j AS (SELECT entity_id, t, i, unnest(range(i + 1, len(t) + 1)) AS j FROM i),
        p AS (SELECT DISTINCT entity_id, array_to_string(t[i:j], ' ') AS phrase FROM j)
        SELECT entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY length(phrase) DESC, phrase) - 1)::INT AS priority, phrase FROM p WHERE length(phrase) >= 4 QUALIFY priority < 20""",
    "g04_hub_names": _G + " SELECT * FROM hub",
    "g05_graph_worthy": _G + f" SELECT entity_id, length({_S('name')}) >= 3 AND lower({_S('name')}) NOT IN ({_NO}) AND NOT regexp_matches(regexp_replace(replace(lower({_S('name')}), ',', ''), 's+$', ''), '^[0-9]+$') AS worthy FROM (SELECT entity_id, coalesce(name, '') AS name FROM en)",
    "g06_triple_confidence": _G + " SELECT src, relation_type, dst, n_support, triple_confidence FROM tc",
    "g08_graph_lane": _G + ", " + _QE + _LOOKUP + """,
        st AS (SELECT DISTINCT query_id, entity_id, name AS matched FROM qk JOIN lo USING (key) JOIN en USING (name)),
        bo AS (SELECT src, dst, max(c) AS c FROM (SELECT src, dst, triple_confidence AS c FROM tc UNION ALL SELECT dst, src, triple_confidence FROM tc) GROUP BY 1, 2),
        sp AS (SELECT query_id, dst, max(c) AS c, min(matched) AS matched FROM st JOIN bo ON entity_id = src JOIN en b ON b.entity_id = dst WHERE b.name NOT IN (SELECT name FROM hub) GROUP BY 1, 2),
        ho AS (SELECT query_id, chunk_id, 0 AS hops, matched, 1::DOUBLE AS confidence FROM st JOIN me USING (entity_id) UNION ALL SELECT query_id, chunk_id, 2, matched, c FROM sp JOIN me ON me.entity_id = dst),
        be AS (SELECT * FROM ho QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY hops, confidence DESC, matched) = 1)
        SELECT query_id, chunk_id, hops, matched, confidence, row_number() OVER (PARTITION BY query_id ORDER BY hops, confidence DESC, chunk_id) AS rank FROM be QUALIFY rank <= 5""",
    "g09_traversal": _G + """, ad AS (SELECT src, dst FROM re UNION SELECT dst, src FROM re), wk AS (SELECT entity_id AS start, entity_id, 0 AS hops FROM gazetteer UNION SELECT start, dst, hops + 1 FROM wk JOIN ad ON ad.src = wk.entity_id WHERE hops < 2)
        SELECT start, entity_id, min(hops) AS hops FROM wk GROUP BY 1, 2""",
    "g11_context_chunks": _G + " SELECT x.chunk_id AS start, y.chunk_id, abs(x.place - y.place)::INT AS hops FROM nx x JOIN nx y ON x.source_file = y.source_file AND y.place - x.place IN (-2, -1, 1, 2)",
    "g13_statistics": _G + """ SELECT 'document_chunks' AS item, count(*) AS n FROM ch UNION ALL SELECT 'source_documents', count(DISTINCT source_file) FROM ch UNION ALL SELECT 'entities', count(*) FROM en UNION ALL SELECT 'from_source_edges', count(*) FROM nx
        UNION ALL SELECT 'next_chunk_edges', count(next_chunk_id) FROM nx UNION ALL SELECT 'mentions_edges', count(*) FROM me UNION ALL SELECT 'related_to_edges', count(*) FROM re""",
    "g14_cooccurrence": _G + " SELECT * FROM co",
    "g15_unsubsumed": _G + " SELECT a, b FROM co WHERE (a, b) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM re)",
    "g16_cleanup": _G + f", d AS (SELECT entity_id, CASE WHEN canon IN ({', '.join(repr(x) for x in STOPLIST)}) THEN 'stoplist' WHEN lone THEN 'orphan' WHEN n > greatest(50, 0.03 * (SELECT count(*) FROM ch)) THEN 'hub' END AS reason FROM cf) SELECT * FROM d WHERE reason IS NOT NULL",
    "g20_duplicate_keepers": _G + " SELECT entity_id, keeper, size FROM ke",
    "g22_redirected": _G + ", z AS (SELECT coalesce(s.keeper, src) AS src, relation_type, coalesce(d.keeper, dst) AS dst, confidence, n_chunks FROM re LEFT JOIN ke s ON s.entity_id = src LEFT JOIN ke d ON d.entity_id = dst) SELECT src, relation_type, dst, round(max(confidence), 6) AS confidence, sum(n_chunks)::BIGINT AS n_chunks FROM z WHERE src <> dst GROUP BY 1, 2, 3",
    "g25_isolated": _G + " SELECT entity_id, entity_type FROM iso",
    "g26_without_isolated": _G + " SELECT entity_type, count(*) AS n_entities, coalesce(sum(n), 0)::BIGINT AS n_mentions FROM en LEFT JOIN dg USING (entity_id) WHERE entity_id NOT IN (SELECT entity_id FROM iso) GROUP BY 1",
    "g27_duplicate_clusters": _G + " SELECT canon, entity_type, max(size) AS size, min(entity_id) AS first_id FROM ke GROUP BY 1, 2 ORDER BY size DESC, canon, entity_type LIMIT 100",
    "g28_top_entities": _G + " SELECT entity_id, n AS n_chunks FROM dg ORDER BY n DESC, entity_id LIMIT 20",
    "g29_baseline": _G + """, t AS (SELECT (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM en) AS entities, (SELECT count(*) FROM me) AS mentions, (SELECT count(*) FROM re) AS relations, (SELECT count(*) FROM iso) AS isolated, (SELECT count(DISTINCT keeper) FROM ke) AS clusters, (SELECT count(*) - count(DISTINCT keeper) FROM ke) AS duplicates),
        r AS (SELECT *, round(entities / chunks, 6) AS entities_per_chunk, round(mentions / chunks, 6) AS mentions_per_chunk, round(relations / chunks, 6) AS relations_per_chunk, round(isolated / entities, 6) AS isolated_rate, round(duplicates / entities, 6) AS duplicate_rate FROM t)
        SELECT *, concat_ws(',', CASE WHEN isolated_rate > 0.05 THEN 'isolated_rate' END, CASE WHEN duplicate_rate > 0.02 THEN 'duplicate_rate' END, CASE WHEN relations_per_chunk < 5 THEN 'relations_per_chunk' END) AS violations FROM r""",
    "g33_edge_sample": _G + " SELECT src, relation_type, dst, n_chunks FROM re ORDER BY n_chunks DESC, src, relation_type, dst LIMIT 2000",
    "e27_question_entities": "WITH " + _QE + " SELECT * FROM qk",
}
