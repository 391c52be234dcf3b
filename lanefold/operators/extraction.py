"""Entity extraction by pattern, name and identifier normal forms, triple parsing, junk and span rules, bridge candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.functions.text import ABBREVIATIONS, ARTICLE_TYPES, canonical_form, canonical_sql, entity_id, normal_name, short_hash, strip, strip_sql
from lanefold.operators.filters import ranked
from lanefold.operators.retrieval import _ALL
from lanefold.sources.shared import load

PROPER = r"([\p{Lu}][\p{Ll}]+(?:\s+[\p{Lu}][\p{Ll}]+)+)"
LEADING = r"(?i)^(is|are|was|were|do|does|did|both|either|neither)\s+"
#: Label words of extractors by canonical type.
LABELS = {
    "PERSON": ["person", "director", "actor", "politician", "scientist", "athlete"],
    "ORGANIZATION": ["organization", "company", "studio", "institution", "org"],
    "GPE": ["city", "country", "state", "gpe"],
    "LOCATION": ["location", "place", "landmark", "monument", "building", "loc", "fac"],
    "WORK_OF_ART": ["film", "movie", "book", "album", "song", "work_of_art", "work of art", "award", "prize"],
    "DATE": ["date", "year", "time"],
    "EVENT": ["event"],
    "PRODUCT": ["product"],
    "TECHNOLOGY": ["technology"],
}
#: Words of roles, which no person's name holds, and question words without weight for bridges.
ROLES = (
    "investigator director producer manager president chairman founder owner captain coach lawyer attorney officer secretary minister governor actor "
    "actress author writer composer pictures studios movie film company corporation investigations agency department division group industries limited "
    "incorporated associates private public"
).split()
BRIDGE_STOPS = (
    "a an and are as at be by do does for from has have he her him his how in is it its of on or that the their they this to was were what when where "
    "which who whom whose why will with would you your i we us our she them"
).split()
#: Words that are no entity of a question, and nouns of measure.
JUNK = (
    "year years month months day days date dates time times person people thing things place places name names kind kinds sort sorts type types "
    "one ones way ways case cases what which who whom whose when where why how the a an"
).split()
MEASURES = "year years season seasons lap laps game games day days month months week weeks hour hours minute minutes times people points miles metres consecutive total first last".split()


def label_type(c: Column) -> Column:
    """The canonical type of an extractor's label; unknown ones in capitals."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.when(low == "", "CONCEPT")
    for kind, labels in LABELS.items():
        out = out.when(low.isin(labels), kind)
    return out.otherwise(F.upper(low))


def pattern_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, n): multi-word capitalised names of each text, with type CONCEPT and confidence 0.5 by definition."""
    e = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(PROPER), F.lit(1))).alias("name"))
    return e.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def e01_pattern_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_entities(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def e06_normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display form, canonical form and the ids of both, for every name and type."""
    e = load(spark, sf_dir, "extracted_entities").where(F.col("name").isNotNull()).select("name", "entity_type").distinct()
    canon = canonical_form(F.col("name"))
    return e.select("name", "entity_type", normal_name(F.col("name"), F.col("entity_type")).alias("normal"), canon.alias("canonical"), entity_id(F.col("name"), F.col("entity_type")).alias("id"), short_hash(F.concat(canon, F.lit(":"), F.col("entity_type")), 24).alias("canonical_id"))


def triples(raw: Column) -> Column:
    """The (subject, object, relation) triples of a generator's output; incomplete ones are left out."""
    parts = F.filter(F.split(raw, "<triplet>"), lambda p: strip(p) != "")
    get = lambda p, pattern: strip(F.regexp_extract(p, pattern, 1))
    rows = F.transform(parts, lambda p: F.struct(get(p, r"(?s)^(.*?)<subj>").alias("subject"), get(p, r"(?s)<subj>(.*?)<obj>").alias("object"), get(p, r"(?s)<obj>(.*?)(?:<|$)").alias("relation")))
    return F.filter(rows, lambda t: (t["subject"] != "") & (t["object"] != "") & (t["relation"] != ""))


def relevant(found: Column, names: Column) -> Column:
    """Triples with a known entity inside subject or object."""
    return F.filter(found, lambda t: F.exists(names, lambda n: F.lower(t["subject"]).contains(F.lower(n)) | F.lower(t["object"]).contains(F.lower(n))))


def e10_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10, E11 as a round trip: each chunk's relations written as generator output, parsed again, gated on two entities."""
    c = load(spark, sf_dir, "chunk_extractions").where(F.size("relations") > 0).groupBy("chunk_id").agg(F.max("relations").alias("r"), F.max("entities.name").alias("names"))
    raw = F.array_join(F.transform("r", lambda x: F.concat(F.lit("<triplet> "), x["subject_entity"], F.lit(" <subj> "), x["object_entity"], F.lit(" <obj> "), x["relation_type"])), " ")
    c = c.where(F.size("names") >= 2).select("chunk_id", F.inline(relevant(triples(raw), F.filter("names", lambda n: n.isNotNull()))))
    return c.distinct()


def e25_extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type, entities listed, distinct ids, confidence range and whether it never varies."""
    e = load(spark, sf_dir, "chunk_extractions").select("chunk_id", F.explode("entities").alias("e")).distinct().select("chunk_id", "e.*")
    return e.groupBy(F.coalesce("entity_type", F.lit("?")).alias("entity_type")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("n_ids"), F.round(F.min("confidence"), 6).alias("lowest"), F.round(F.max("confidence"), 6).alias("highest"),
        F.round(F.avg("confidence"), 6).alias("mean"), (F.min("confidence") == F.max("confidence")).alias("constant"),
    )


def junk(c: Column) -> Column:
    """Junk words, nothing with a letter or under three characters, and mere measures."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    words = F.split(low, r"\s+")
    measure = F.forall(words, lambda w: w.rlike(r"^[\d.,]+s?$") | w.isin(MEASURES))
    return low.isin(JUNK) | (F.length(low) < 3) | ~low.rlike(r"\p{L}") | measure


def lead_and_year(c: Column) -> tuple[Column, Column]:
    """The text without a leading auxiliary and an interior year, and that year (empty if none)."""
    s = F.regexp_replace(strip(c), LEADING, "")
    year = F.regexp_extract(s, r"\p{L}\s+(1\d{3}|20\d{2})\s+\p{L}", 1)
    return F.when(year != "", F.regexp_replace(s, r"(\p{L})\s+(?:1\d{3}|20\d{2})\s+(\p{L})", "$1 $2")).otherwise(s), year


def e16_chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's entities once by lower-cased name and type, with the best confidence."""
    e = load(spark, sf_dir, "chunk_extractions").where(F.col("chunk_id").isNotNull()).select("chunk_id", F.explode("entities").alias("e"))
    key = F.lower(strip(F.coalesce("e.name", F.lit(""))))
    return e.where(key != "").groupBy("chunk_id", key.alias("key"), F.col("e.entity_type").alias("entity_type")).agg(F.round(F.max("e.confidence"), 6).alias("confidence"))


def e28_query_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E28 to E30, E32, E33 over the distinct questions."""
    q = load(spark, sf_dir, "agentic_ablation").where(F.col("question").isNotNull()).select("question_id", "question").distinct()
    text, year = lead_and_year(F.col("question"))
    return q.select("question_id", text.alias("stripped"), year.alias("year"), junk(F.col("question")).alias("junk"))


def e30_query_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's capitalised runs and quoted strings without junk, the first of each lower-cased form, in order."""
    q = load(spark, sf_dir, "agentic_ablation").where(F.col("question").isNotNull()).select("question_id", "question").distinct()
    runs = F.regexp_extract_all("question", F.lit(r"([\p{Lu}][\p{L}&'-]+(?:\s+[\p{Lu}][\p{L}&'-]+)*)"), F.lit(1))
    keys = F.filter(F.concat(runs, F.regexp_extract_all("question", F.lit('"([^"]+)"'), F.lit(1))), lambda x: ~junk(x))
    form = lambda x: F.lower(strip(x))
    once = F.filter("keys", lambda x, i: ~F.exists(F.slice("keys", 1, i), lambda y: form(y) == form(x)))
    return q.withColumn("keys", keys).select("question_id", F.posexplode(once).alias("pos", "key"))


def e31_outer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention spans of a chunk that no longer span contains."""
    e = load(spark, sf_dir, "chunk_extractions").select("chunk_id", F.explode("entities").alias("e")).where(F.size("e.mention_span") == 2)
    s = e.select("chunk_id", F.col("e.entity_id").alias("entity_id"), F.col("e.mention_span")[0].alias("a"), F.col("e.mention_span")[1].alias("z")).where("entity_id is not null and a is not null and z is not null").distinct()
    o = s.select(F.col("chunk_id").alias("c"), F.col("a").alias("oa"), F.col("z").alias("oz"))
    inside = (F.col("c") == F.col("chunk_id")) & (F.col("oa") <= F.col("a")) & (F.col("z") <= F.col("oz")) & (F.col("oz") - F.col("oa") > F.col("z") - F.col("a"))
    return s.join(o, inside, "left_anti")


def expected_type(c: Column) -> Column:
    """the answer type of the first question word in the order who, whose, whom, where, when."""
    q = F.lower(strip(F.coalesce(c, F.lit(""))))
    said = lambda w: q.startswith(w + " ") | q.contains(f" {w} ")
    return F.when(said("who") | said("whose") | said("whom"), "PERSON").when(said("where"), "GPE").when(said("when"), "DATE").when(q.rlike(r"\bthe\s+\w+\s+who\b"), "PERSON")


def f21_bridge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best bridge candidates of each question among its five best chunks.

    A candidate is a capitalised name of the chunk that the question lacks. Its score is the nearness to a question word,
    1 / (1 + distance / 200), plus 0.5 for two or three words where a person is asked for (or minus 0.3 with a word of
    role), plus 0.3 for at most two words where a place is, plus 0.1 for two words, minus 0.2 for four or more, minus up
    to 0.5 for standing late, not below 0, over the chunk's rank. Without a question word in the chunk there is none.
    """
    q = load(spark, sf_dir, "agentic_ablation").where(F.col("question").isNotNull()).groupBy(F.col("question_id").alias("query_id")).agg(F.max("question").alias("question"))
    keys = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("question"), F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1)), lambda w: ~w.isin(BRIDGE_STOPS)))
    q = q.select("query_id", "question", keys.alias("keys"), F.coalesce(expected_type(F.col("question")), F.lit("")).alias("want"))
    r = ranked(spark, sf_dir).where(F.col("rank") <= 5).join(q, "query_id").withColumn("low", F.lower("text"))
    c = r.select("query_id", "question", "want", "keys", "low", "rank", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PROPER), F.lit(1)))).alias("candidate")).where(~F.lower("question").contains(F.lower("candidate")))
    c = c.withColumn("at", F.instr("low", F.lower("candidate")) - 1)
    places = F.transform(F.filter("keys", lambda k: F.col("low").contains(k)), lambda k: F.abs(F.position(k, F.col("low")) - 1 - F.col("at")))
    c = c.withColumn("near", F.array_min(places)).where(F.col("near").isNotNull())
    words = F.split("candidate", r"\s+")
    n, role = F.size(words), F.exists(words, lambda w: F.lower(w).isin(ROLES))
    kind = F.when((F.col("want") == "PERSON") & role, -0.3).when((F.col("want") == "PERSON") & n.between(2, 3), 0.5).when((F.col("want") == "GPE") & (n <= 2), 0.3).otherwise(0.0)
    length = F.when(n == 2, 0.1).when(n >= 4, -0.2).otherwise(0.0)
    score = 1 / (1 + F.col("near") / 200) + kind + length - F.least(F.lit(0.5), F.col("at") / 600)
    c = c.withColumn("score", F.round(F.greatest(F.lit(0.0), score) / F.col("rank"), 6)).groupBy("query_id", "question", "candidate").agg(F.max("score").alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate")
    top = c.withColumn("place", F.row_number().over(w)).where("place <= 3")
    return top.select("query_id", "candidate", "score", "place", F.concat(F.regexp_replace("question", r"\s*\?+$", ""), F.lit(" — about "), F.col("candidate")).alias("next_query"))


def e04_label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E04, E05, E37 over the labels of the extraction lists: canonical type, and confidence raised by up to 0.1 for length."""
    e = load(spark, sf_dir, "chunk_extractions").select(F.explode("entities").alias("e")).select("e.name", "e.entity_type", "e.confidence").where(F.col("name").isNotNull()).distinct()
    n = F.size(F.split(strip(F.col("name")), r"\s+"))
    raised = F.round(F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)) + F.least(F.lit(0.1), 0.03 * n)), 6)
    return e.groupBy("entity_type").agg(F.max(label_type(F.col("entity_type"))).alias("canonical_type"), F.count(F.lit(1)).alias("n"), F.round(F.avg(raised), 8).alias("mean_raised"))


QUERIES = {f.__name__: f for f in (e01_pattern_entities, e04_label_types, e06_normal_names, e10_triples, e16_chunk_entities, e25_extraction_summary, e28_query_spans, e30_query_names, e31_outer_spans, f21_bridge_entities)}

_JUNK = ", ".join(f"'{x}'" for x in JUNK)
_KEEP = " OR ".join(f"ends_with(s, '{a}')" for a in ABBREVIATIONS)
_KEY_OUT = ", ".join(f"'{x}'" for x in BRIDGE_STOPS)
_ROLE = ", ".join(f"'{x}'" for x in ROLES)
ORACLE = {
    "e01_pattern_entities": rf"SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PROPER}', 1)) AS name FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2",
    "e06_normal_names": f"""WITH e AS (SELECT DISTINCT name, entity_type, regexp_replace({strip_sql('name')}, '[,;:]+$', '') AS s FROM extracted_entities WHERE name IS NOT NULL),
        d AS (SELECT *, CASE WHEN ends_with(s, '.') AND NOT ({_KEEP}) THEN regexp_replace(s, '\\.$', '') ELSE s END AS t, {canonical_sql('name')} AS canonical FROM e)
        SELECT name, entity_type, CASE WHEN entity_type IN ({', '.join(f"'{x}'" for x in ARTICLE_TYPES)}) THEN regexp_replace(t, '^(?:The|A|An) (..)', '\\1') ELSE t END AS normal, canonical,
            substring(sha256(lower({strip_sql('name')}) || ':' || entity_type), 1, 24) AS id, substring(sha256(canonical || ':' || entity_type), 1, 24) AS canonical_id FROM d""",
    "e10_triples": f"""WITH c AS (SELECT chunk_id, max(relations) AS r, max(list_transform(entities, lambda x: x.name)) AS names FROM chunk_extractions WHERE len(relations) > 0 GROUP BY 1), u AS (SELECT chunk_id, names, unnest(r) AS r FROM c WHERE len(names) >= 2),
        t AS (SELECT chunk_id, names, {strip_sql('r.subject_entity')} AS subject, {strip_sql('r.object_entity')} AS object, {strip_sql('r.relation_type')} AS relation FROM u)
        SELECT DISTINCT chunk_id, subject, object, relation FROM t WHERE subject <> '' AND object <> '' AND relation <> '' AND len(list_filter(names, lambda n: n IS NOT NULL AND (contains(lower(subject), lower(n)) OR contains(lower(object), lower(n))))) > 0""",
    "e16_chunk_entities": f"SELECT chunk_id, lower({strip_sql('e.name')}) AS key, e.entity_type AS entity_type, round(max(e.confidence), 6) AS confidence FROM (SELECT chunk_id, unnest(entities) AS e FROM chunk_extractions WHERE chunk_id IS NOT NULL) WHERE lower({strip_sql("coalesce(e.name, '')")}) <> '' GROUP BY 1, 2, 3",
    "e25_extraction_summary": """WITH u AS (SELECT DISTINCT chunk_id, e FROM (SELECT chunk_id, unnest(entities) AS e FROM chunk_extractions))
        SELECT coalesce(e.entity_type, '?') AS entity_type, count(*) AS n, count(DISTINCT e.entity_id) AS n_ids, round(min(e.confidence), 6) AS lowest, round(max(e.confidence), 6) AS highest, round(avg(e.confidence), 6) AS mean, min(e.confidence) = max(e.confidence) AS constant FROM u GROUP BY 1""",
    "e28_query_spans": rf"""WITH q AS (SELECT DISTINCT question_id, question, regexp_replace({strip_sql('question')}, '{LEADING}', '') AS s, lower({strip_sql('question')}) AS low FROM agentic_ablation WHERE question IS NOT NULL),
        y AS (SELECT *, regexp_extract(s, '\p{{L}}\s+(1\d{{3}}|20\d{{2}})\s+\p{{L}}', 1) AS year FROM q)
        SELECT question_id, CASE WHEN year <> '' THEN regexp_replace(s, '(\p{{L}})\s+(?:1\d{{3}}|20\d{{2}})\s+(\p{{L}})', '\1 \2', 'g') ELSE s END AS stripped, year, low IN ({_JUNK}) OR length(low) < 3 OR NOT regexp_matches(low, '\p{{L}}')
            OR len(list_filter(regexp_split_to_array(low, '\s+'), lambda w: NOT regexp_matches(w, '^[\d.,]+s?$') AND w NOT IN ({', '.join(f"'{x}'" for x in MEASURES)}))) = 0 AS junk FROM y""",
    "e30_query_names": rf"""WITH q AS (SELECT DISTINCT question_id, list_concat(regexp_extract_all(question, '[\p{{Lu}}][\p{{L}}&''-]+(?:\s+[\p{{Lu}}][\p{{L}}&''-]+)*'), regexp_extract_all(question, '"([^"]+)"', 1)) AS k FROM agentic_ablation WHERE question IS NOT NULL),
        j AS (SELECT question_id, list_filter(k, lambda x: NOT (lower({strip_sql('x')}) IN ({_JUNK}) OR length(lower({strip_sql('x')})) < 3 OR NOT regexp_matches(lower({strip_sql('x')}), '\p{{L}}')
            OR len(list_filter(regexp_split_to_array(lower({strip_sql('x')}), '\s+'), lambda w: NOT regexp_matches(w, '^[\d.,]+s?$') AND w NOT IN ({', '.join(f"'{x}'" for x in MEASURES)}))) = 0)) AS k FROM q),
        o AS (SELECT question_id, list_filter(k, lambda x, i: len(list_filter(k[1:i - 1], lambda y: lower({strip_sql('y')}) = lower({strip_sql('x')}))) = 0) AS k FROM j)
        SELECT question_id, (generate_subscripts(k, 1) - 1)::INT AS pos, unnest(k) AS key FROM o""",
    "e31_outer_spans": """WITH s AS (SELECT DISTINCT chunk_id, e.entity_id AS entity_id, e.mention_span[1] AS a, e.mention_span[2] AS z FROM (SELECT chunk_id, unnest(entities) AS e FROM chunk_extractions) WHERE len(e.mention_span) = 2)
        SELECT * FROM s WHERE entity_id IS NOT NULL AND a IS NOT NULL AND z IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.chunk_id = s.chunk_id AND o.entity_id IS NOT NULL AND o.a <= s.a AND s.z <= o.z AND o.z - o.a > s.z - s.a)""",
    "f21_bridge_entities": _ALL + rf""", kx AS (SELECT query_id, chunk_id, rank FROM t WHERE rank <= 5), xt AS (SELECT chunk_id, max(text) AS text FROM chunk_extractions GROUP BY 1), qs AS (SELECT question_id AS query_id, max(question) AS question FROM agentic_ablation WHERE question IS NOT NULL GROUP BY 1),
        ql AS (SELECT query_id, question, lower({strip_sql('question')}) AS ql FROM qs), qk AS (SELECT query_id, question, list_distinct(list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]{{3,}}'), lambda w: w NOT IN ({_KEY_OUT}))) AS ks,
            CASE WHEN regexp_matches(ql, '(^| )(who|whose|whom) ') THEN 'PERSON' WHEN regexp_matches(ql, '(^| )where ') THEN 'GPE' WHEN regexp_matches(ql, '(^| )when ') THEN 'DATE' WHEN regexp_matches(ql, '\bthe\s+\w+\s+who\b') THEN 'PERSON' ELSE '' END AS want FROM ql),
        ca AS (SELECT query_id, question, ks, want, lower(text) AS low, rank, unnest(list_distinct(regexp_extract_all(text, '{PROPER}', 1))) AS candidate FROM kx JOIN xt USING (chunk_id) JOIN qk USING (query_id)),
        ps AS (SELECT *, instr(low, lower(candidate)) - 1 AS cpos, regexp_split_to_array(candidate, '\s+') AS cw FROM ca WHERE NOT contains(lower(question), lower(candidate))),
        nr AS (SELECT *, list_min(list_transform(list_filter(ks, lambda k: contains(low, k)), lambda k: abs(instr(low, k) - 1 - cpos))) AS near, len(cw) AS n, len(list_filter(cw, lambda w: lower(w) IN ({_ROLE}))) > 0 AS role FROM ps),
        sc AS (SELECT query_id, question, candidate, max(round(greatest(0, 1 / (1 + near / 200) + CASE WHEN want = 'PERSON' AND role THEN -0.3 WHEN want = 'PERSON' AND n BETWEEN 2 AND 3 THEN 0.5 WHEN want = 'GPE' AND n <= 2 THEN 0.3 ELSE 0 END::DOUBLE
            + CASE WHEN n = 2 THEN 0.1 WHEN n >= 4 THEN -0.2 ELSE 0 END::DOUBLE - least(0.5, cpos / 600)) / rank, 6)) AS score FROM nr WHERE near IS NOT NULL GROUP BY 1, 2, 3)
        SELECT query_id, candidate, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) AS place, regexp_replace(question, '\s*\?+$', '') || ' — about ' || candidate AS next_query FROM sc WHERE score > 0 QUALIFY place <= 3""",
    "e04_label_types": f"""WITH e AS (SELECT DISTINCT e.name AS name, e.entity_type AS entity_type, e.confidence AS confidence FROM (SELECT unnest(entities) AS e FROM chunk_extractions) WHERE e.name IS NOT NULL)
        SELECT entity_type, CASE {' '.join(f"WHEN lower(coalesce(entity_type, '')) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in LABELS.items())} WHEN coalesce(entity_type, '') = '' THEN 'CONCEPT' ELSE upper(entity_type) END AS canonical_type, count(*) AS n,
            round(avg(least(1, coalesce(confidence, 0) + least(0.1::DOUBLE, 0.03::DOUBLE * len(regexp_split_to_array({strip_sql('name')}, '\\s+'))))), 8) AS mean_raised FROM e GROUP BY 1""",
}
