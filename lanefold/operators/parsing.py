"""Operators over given dependency parses: (doc, sent, i, head, text, lemma, pos, dep), one row a token, the root its own head.

No parser is bundled; any parser's output in this form can be put in. Sentences are the unit of every join, so work grows
with the tokens whatever the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.functions.text import canonical_form
from lanefold.operators.graph import containing

#: Labels of subjects, patients, objects and agents, parts of speech of a phrase's head, verbs without a relation.
SUBJECTS, PASSIVE, OBJECTS, AGENTS = ["nsubj"], ["nsubjpass", "nsubj:pass"], ["dobj", "obj"], ["agent", "obl:agent"]
HEADS = ["NOUN", "PROPN"]
NOISE_VERBS = "be have do say tell make".split()
#: Least letters of a lemma, confidence of a triple, least letters of a name found inside another.
MIN_LEMMA, CONFIDENCE, MIN_NAME = 3, 0.7, 4
KEYS = ["doc", "sent"]


def side(tokens: DataFrame, name: str, deps: list[str]) -> DataFrame:
    """(doc, sent, head, name): the first dependent with one of the labels of each head."""
    d = tokens.where(F.col("dep").isin(deps) & F.col("pos").isin(HEADS))
    return d.groupBy(*KEYS, "head").agg(F.min("i").alias(name))


def phrases(tokens: DataFrame) -> DataFrame:
    """(doc, sent, i, phrase): every noun with the compounds in front of it, in order."""
    nouns = tokens.where(F.col("pos").isin(HEADS))
    own = nouns.select(*KEYS, F.col("i").alias("root"), "i", "text")
    inner = nouns.where(F.col("dep") == "compound").select(*KEYS, F.col("head").alias("root"), "i", "text")
    parts = own.unionByName(inner.where(F.col("i") < F.col("root")))
    return parts.groupBy(*KEYS, "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("phrase")).withColumnRenamed("root", "i")


def clauses(tokens: DataFrame) -> DataFrame:
    """(doc, sent, verb, lemma, subject, object): active clauses, passive ones turned round, else the sides of a verb's conjunct head."""
    verbs = tokens.where((F.col("pos") == "VERB") & (F.length("lemma") >= MIN_LEMMA) & ~F.lower("lemma").isin(NOISE_VERBS))
    verbs = verbs.select(*KEYS, F.col("i").alias("verb"), F.lower("lemma").alias("lemma"), "head", "dep")
    agent = tokens.where(F.col("dep") == "pobj").select(*KEYS, F.col("head").alias("by"), F.col("i").alias("pobj"))
    by = tokens.where(F.col("dep").isin(AGENTS)).select(*KEYS, F.col("head").alias("verb_"), F.col("i").alias("by"))
    doer = by.join(agent, [*KEYS, "by"], "left").groupBy(*KEYS, F.col("verb_").alias("head")).agg(F.min(F.coalesce("pobj", "by")).alias("doer"))
    inner = tokens.where((F.col("dep") == "pobj") & F.col("pos").isin(HEADS)).select(*KEYS, F.col("head").alias("prep"), F.col("i").alias("pobj"))
    preps = tokens.where(F.col("dep") == "prep").select(*KEYS, "head", F.col("i").alias("prep")).join(inner, [*KEYS, "prep"])
    behind = preps.groupBy(*KEYS, "head").agg(F.min(F.struct("prep", "pobj"))["pobj"].alias("behind"))
    out = verbs
    for sides in (side(tokens, "subject", SUBJECTS), side(tokens, "object", OBJECTS), behind, side(tokens, "patient", PASSIVE), doer):
        out = out.join(sides.withColumnRenamed("head", "verb"), [*KEYS, "verb"], "left")
    out = out.withColumn("object", F.coalesce("object", "behind"))  # without a direct object the first one behind a preposition
    active, passive = F.col("subject").isNotNull() & F.col("object").isNotNull(), F.col("patient").isNotNull() & F.col("doer").isNotNull()
    out = out.select(*KEYS, "verb", "lemma", "head", "dep", F.when(active, F.col("subject")).when(passive, F.col("doer")).alias("s"), F.when(active, F.col("object")).when(passive, F.col("patient")).alias("o"), F.col("subject").alias("own_s"), F.col("object").alias("own_o"))
    heads = out.select(*KEYS, F.col("verb").alias("head"), F.coalesce("s", "own_s").alias("head_s"), F.coalesce("o", "own_o").alias("head_o"))
    out = out.join(heads, [*KEYS, "head"], "left")
    inherit = (F.col("dep") == "conj") & F.col("s").isNull()
    s = F.when(inherit, F.coalesce("own_s", "head_s")).otherwise(F.col("s"))
    o = F.when(inherit, F.coalesce("own_o", "head_o")).otherwise(F.col("o"))
    return out.select(*KEYS, "verb", "lemma", s.alias("subject"), o.alias("object")).where(F.col("subject").isNotNull() & F.col("object").isNotNull())


def matched(phrases_: DataFrame, names: DataFrame) -> DataFrame:
    """(phrase, entity_id): the entity whose canonical form equals the phrase's, else the one with the longest form that
    contains it or stands in it, both of MIN_NAME letters or more. ``names``: canon, entity_id, one row a form."""
    p = phrases_.select("phrase").distinct().withColumn("canon", canonical_form(F.col("phrase"))).where(F.col("canon") != "")
    exact = p.join(names, "canon").select("phrase", "entity_id", F.lit(10**6).alias("n"))
    forms = names.where(F.length("canon") >= MIN_NAME)
    keys = p.where(F.length("canon") >= MIN_NAME)
    inside = containing(keys.select(F.col("canon").alias("key")).distinct(), forms.select(F.col("canon").alias("name"))).select(F.col("key").alias("canon"), "name")
    around = containing(forms.select(F.col("canon").alias("key")), keys.select(F.col("canon").alias("name")).distinct()).select(F.col("name").alias("canon"), F.col("key").alias("name"))
    part = keys.join(inside.unionByName(around), "canon").join(forms.withColumnRenamed("canon", "name"), "name").select("phrase", "entity_id", F.length("name").alias("n"))
    w = Window.partitionBy("phrase").orderBy(F.desc("n"), "entity_id")
    return exact.unionByName(part).withColumn("_i", F.row_number().over(w)).where("_i = 1").select("phrase", "entity_id")


def svo_relations(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, src, relation_type, dst, confidence): distinct triples whose two sides are different known entities."""
    p = phrases(tokens)
    c = clauses(tokens)
    for end, name in (("subject", "src"), ("object", "dst")):
        c = c.join(p.select(*KEYS, F.col("i").alias(end), F.col("phrase").alias(f"{end}_phrase")), [*KEYS, end])
        c = c.join(matched(p, names).select(F.col("phrase").alias(f"{end}_phrase"), F.col("entity_id").alias(name)), f"{end}_phrase")
    return c.where(F.col("src") != F.col("dst")).select("doc", "src", F.col("lemma").alias("relation_type"), "dst").distinct().withColumn("confidence", F.lit(CONFIDENCE))


def passive_agents(tokens: DataFrame) -> DataFrame:
    """P10: (doc, sub_query): "Who <verb> <subject>?" of a passive clause whose subject is no question word or bare pronoun."""
    bare = "that this these those it he she they them who whom someone something somebody".split()
    patient = side(tokens, "patient", PASSIVE)
    verbs = tokens.select(*KEYS, F.col("i").alias("head"), F.lower("lemma").alias("lemma"))
    c = patient.join(verbs, [*KEYS, "head"]).join(phrases(tokens).withColumnRenamed("i", "patient"), [*KEYS, "patient"])
    low = F.lower("phrase")
    c = c.where(~low.isin(bare) & ~low.rlike(r"^(what|which|whose)\b"))
    return c.groupBy("doc").agg(F.min(F.struct("sent", "patient", F.concat_ws(" ", F.lit("Who"), "lemma", F.concat("phrase", F.lit("?"))).alias("q"))).alias("x")).select("doc", F.col("x.q").alias("sub_query"))


def relational_nouns(tokens: DataFrame, named: DataFrame) -> DataFrame:
    """(doc, sub_query): "Who is the <noun> of <entity>?" where an of-phrase of the noun holds a name (``named``: doc, name)."""
    of = tokens.where((F.col("dep") == "prep") & (F.lower("text") == "of")).select(*KEYS, F.col("head").alias("noun"), F.col("i").alias("of"))
    inner = tokens.where(F.col("dep") == "pobj").select(*KEYS, F.col("head").alias("of"), F.col("i").alias("pobj"))
    nouns = tokens.where(F.col("pos") == "NOUN").select(*KEYS, F.col("i").alias("noun"), F.lower("text").alias("role"))
    c = of.join(inner, [*KEYS, "of"]).join(nouns, [*KEYS, "noun"]).join(phrases(tokens).withColumnRenamed("i", "pobj"), [*KEYS, "pobj"]).join(named, "doc").where(F.lower("name").contains(F.lower("phrase")))
    return c.groupBy("doc").agg(F.min(F.struct("sent", "noun", F.concat(F.lit("Who is the "), "role", F.lit(" of "), "name", F.lit("?")).alias("q"))).alias("x")).select("doc", F.col("x.q").alias("sub_query"))


def sure_triples(triples: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """(chunk_id, subject, relation, object, probability) of a generator's triples (with ``score``, a log probability) whose
    exp(score), clamped to [0.0001, 1], is at least ``least`` and whose subject or object has a known name as whole words."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(1e-4), F.exp("score")))
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    t = triples.withColumn("probability", p).where(F.col("probability") >= least).join(names.groupBy("chunk_id").agg(F.collect_set("name").alias("_names")), "chunk_id")
    held = F.exists("_names", lambda n: words(F.col("subject")).contains(words(n)) | words(F.col("object")).contains(words(n)))
    return t.where(held).select("chunk_id", "subject", "relation", "object", F.round("probability", 6).alias("probability")).distinct()


