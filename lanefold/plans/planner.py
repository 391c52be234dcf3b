"""Rule-based question planning as columns: class, strategy, constraints, hops and sub-queries of a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.text import strip, strip_sql
from lanefold.sources.shared import load

#: The surface patterns of each question class, in the order in which classes win ties.
FAMILIES = {
    "comparison": [
        r"\b(older|younger|taller|shorter|bigger|smaller|larger|higher|lower)\s+than\b", r"\b(more|less|fewer)\s+\w+\s+than\b", r"\b(compare|comparison|versus|vs\.?|vs)\b",
        r"\bdifference\s+between\b", r"\bwhich\s+(is|was|are|were)\s+\w*(er|est)\b", r"\b(better|worse|best|worst)\b.*\bor\b", r"\bor\b.*\?(which|what)\s+(is|was)\s+\w*(er|est)",
        r"\bsame\s+\w+\b", r"\bboth\s+.+\s+(born|from|have|had|were|are)\b", r"\b(older|younger|taller|shorter|bigger|smaller|larger|higher|lower|richer|poorer)\b.{0,60}\bor\b",
    ],
    "multi_hop": [
        r"\bof\s+(a|an|the)\s+\w+\s+(that|which|who)\b", r"\bwhere\s+.+\s+(was|is|were|are)\b", r"\b\w+\s+of\s+the\s+\w+\s+of\b", r"'s\s+\w+'s",
        r"\b(who|what)\s+\w+\s+(the|a)\s+\w+\s+(that|which)\b", r"\b(starring|featuring|directed by|written by|authored by|composed by)\b",
        r"\b(father|mother|son|daughter|wife|husband|creator|founder)\s+of\b", r"\b(located|situated)\s+in\s+the\b", r"\b(formed|created|founded|established|organized|produced|released)\s+by\b",
        r"\b\w+\s+(group|band|company|team|studio|label)\s+(that|which|who)\b", r"\bformed\s+by\b", r"\bwas\s+\w+ed\s+by\b", r"\b(debut|first|second)\s+(album|single|film|movie|show)\s+of\b",
    ],
    "temporal": [
        r"\b(before|after|during|since|until|when|while)\b", r"\b(year|month|day|century|decade|era)\s+\d+", r"\b\d{4}\b", r"\b(first|last|latest|earliest|recent|previous|next)\b",
        r"\b(history|historical|timeline|chronolog)\w*\b", r"\b(began|started|ended|founded|established)\b",
    ],
    "intersection": [r"\bboth\s+.+\s+and\b", r"\bin\s+common\b", r"\b(also|too)\b.*\band\b", r"\bshared\s+(by|between)\b"],
    "aggregate": [r"\b(list|enumerate|all|every|count|how\s+many)\b", r"\b(summarize|summary|overview)\b", r"\bwhat\s+(are|were)\s+the\b"],
}
#: The surface forms that decide a class at once.
BOTH = r"^\s*(are|is|were|was|did|do|does|have|has)\b.+\band\b.+\bboth\b"
ANOTHER = r"\banother\s+(\w+)\b"
#: Years, words of time, of greater and of less, and compared attributes.
YEAR = r"\b(1\d{3}|20\d{2})\b"
TERMS = r"\b(before|after|during|since|until|recent|latest|first|last)\b"
GREATER, LESS = r"\b(older|bigger|larger|more|higher|greater)\b", r"\b(younger|smaller|less|lower|fewer)\b"
ATTRIBUTE = r"\b(older|younger|taller|shorter|bigger|smaller|richer|poorer)\b"
#: What opens a fragment, what makes it a question, what a split happens at, vague references and their nouns.
CONJ, ASKS = r"^(?:and|or|but|that|which|who|where)\s+", r"^(what|who|where|when|why|how|which|is|are|was|were|did|does|do)\b"
SPLITS = (r"\s+(?:that|which|who)\s+", r"\s+of\s+the\s+")
VAGUE = r"\b(the\s+(?:woman|man|person|actor|actress|director|author|artist|president|player|team|group|band|company|film|movie|show|song|book))\b"
KIND = r"\b(?:a|an|the)\s+((?:\w+\s+){1,3}(?:group|band|company|team|label|artist|person|film|movie|show))\b"
WH = "which who whom whose what where when why how".split()
LEAD = r"^\s*(which|what|who|whom)\b\s*([a-z][a-z\- ]{0,30}?\b)?\s*"
#: Shared attributes of a comparison and the question that asks one side for it.
SHARED = [
    (r"\bsame\s+nationality\b", "What is the nationality of {}?"),
    (r"\bsame\s+(?:birth\s*place|birthplace|hometown)\b", "Where was {} born?"),
    (r"\bborn\s+in\s+the\s+same\b", "Where was {} born?"),
    (r"\bsame\s+(?:profession|occupation|job)\b", "What is the profession of {}?"),
    (r"\bsame\s+(?:genre|style)\b", "What genre is {}?"),
    (r"\bsame\s+(?:age|birth\s*year)\b", "When was {} born?"),
    (r"\bsame\s+(?:country|state|city)\b", "What country is {} from?"),
    (r"\bsame\s+(?:religion|faith|belief)\b", "What is the religion of {}?"),
    (r"\b(older|younger)\b", "When was {} born?"),
]
#: Entity patterns of a question with their labels, words that are none, and words inside one name.
NAMED = [(r'"([^"]+)"', "QUOTED"), (r"'([^']+)'", "QUOTED"), (r"([\p{Lu}][\p{Ll}]+(?:\s+[\p{Lu}][\p{Ll}]+)+)", "PROPN"), (r"\b([A-Z][a-z]{2,})\b", "PROPN"), (r"\b(\d{4})\b", "DATE")]
NO_NAMES = (
    "the a an this that these those however therefore furthermore moreover although because since while when what which who whom whose where how why "
    "if then else but and or"
).split()
INSIDE = "to of on in the for at de von van del della di le la".split()
OPENING = r"(?i)^(is|are|was|were|do|does|did|both|either|neither)\s+"
SHORT_GAP, MAX_NAMED, SHORT_NAME = 12, 10, 5
#: Base confidence of entity labels; length adds 0.03 a word, 0.1 at most.
LABEL_BASE = {"PERSON": 0.9, "ORG": 0.85, "GPE": 0.9, "LOC": 0.85, "DATE": 0.95, "EVENT": 0.8, "WORK_OF_ART": 0.75}
BASE, SCALE, CAP, FALLBACK, PRE, PATTERN_CONFIDENCE = 0.6, 0.15, 0.95, 0.7, 0.9, 0.75


def like(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def classified(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """(query_id, question, query_type, confidence). Two patterns decide at once, else the class with most hits.

    A class of several hops takes over the hits of a stronger temporal reading; no hit means a single hop. Null is empty.
    """
    q = questions.select(F.col(qid).alias("query_id"), strip(F.coalesce(F.col(text), F.lit(""))).alias("question"))
    for name, patterns in FAMILIES.items():
        q = q.withColumn(f"s_{name}", sum((like(F.col("question"), p).cast("int") for p in patterns), F.lit(0)))
    q = q.withColumn("s_multi_hop", F.when((F.col("s_multi_hop") > 0) & (F.col("s_temporal") > F.col("s_multi_hop")), F.col("s_temporal")).otherwise(F.col("s_multi_hop")))
    top = F.greatest(*[F.col(f"s_{n}") for n in FAMILIES])
    kind = F.when(like(F.col("question"), BOTH), "comparison").when(like(F.col("question"), ANOTHER), "multi_hop").when(top == 0, "single_hop")
    conf = F.when(like(F.col("question"), BOTH) | like(F.col("question"), ANOTHER), PRE).when(top == 0, FALLBACK).otherwise(F.least(F.lit(CAP), BASE + SCALE * top))
    for n in FAMILIES:
        kind = kind.when(F.col(f"s_{n}") == top, n)
    return q.select("query_id", "question", kind.alias("query_type"), F.round(conf, 6).alias("confidence"))


def sub_query(c: Column) -> Column:
    """A fragment as a question of its own."""
    part = F.regexp_replace(strip(c), "(?i)" + CONJ, "")
    return F.when(part.endswith("?"), part).when(like(part, ASKS), F.concat(part, F.lit("?"))).otherwise(F.concat(F.lit("What is "), part, F.lit("?")))


def question_names(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """(query_id, question, named): up to MAX_NAMED entities of each question in order, as (start, stop, text, label, confidence).

    Each pattern's finds of more than two letters, without an opening auxiliary (E32), count once by lower-cased text, the earlier pattern first, at their first
    place. Short single names and single words inside another name are dropped. Neighbours with nothing, a possessive or
    words of INSIDE in at most SHORT_GAP letters between them are one name again.
    """
    q = F.col("question")
    rows = questions.select(F.col(qid).alias("query_id"), strip(F.coalesce(F.col(text), F.lit(""))).alias("question"))
    tagged = lambda label: lambda x: F.struct(strip(F.regexp_replace(strip(x), OPENING, "")).alias("text"), F.lit(label).alias("label"))
    found = F.concat(*[F.transform(F.regexp_extract_all(q, F.lit(p), F.lit(1)), tagged(label)) for p, label in NAMED])
    rows = rows.withColumn("f", F.filter(found, lambda x: (F.length(x["text"]) > 2) & ~F.lower(x["text"]).isin(NO_NAMES)))
    once = F.filter("f", lambda x, i: ~F.exists(F.slice("f", 1, i), lambda y: F.lower(y["text"]) == F.lower(x["text"])))
    placed = F.transform(once, lambda x: F.struct((F.instr(q, x["text"]) - 1).alias("start"), (F.instr(q, x["text"]) - 1 + F.length(x["text"])).alias("stop"), x["text"].alias("text"), x["label"].alias("label")))
    rows = rows.withColumn("f", F.array_sort(placed))
    whole = F.filter("f", lambda x: ~((x["label"] == "PROPN") & (F.length(x["text"]) < SHORT_NAME)) & (x["text"].contains(" ") | ~F.exists("f", lambda y: (F.lower(y["text"]) != F.lower(x["text"])) & F.lower(y["text"]).contains(F.lower(x["text"])))))
    rows = rows.withColumn("f", whole)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.substring(q, last["stop"] + 1, x["start"] - last["stop"])
        bare = F.filter(F.split(F.regexp_replace(F.lower(strip(gap)), "^'+|'+$", ""), r"\s+"), lambda t: t != "")
        joins = (x["start"] >= last["stop"]) & (F.length(gap) <= SHORT_GAP) & (strip(gap).isin("", "'s", "’s") | ((F.size(bare) > 0) & F.forall(bare, lambda t: t.isin(INSIDE))))
        label = F.when(last["label"].isin("PROPN", "QUOTED") & ~x["label"].isin("PROPN", "QUOTED"), x["label"]).otherwise(last["label"])
        one = F.struct(last["start"].alias("start"), x["stop"].alias("stop"), strip(F.substring(q, last["start"] + 1, x["stop"] - last["start"])).alias("text"), label.alias("label"))
        return F.when((F.size(acc) > 0) & joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(x)))

    joined = F.slice(F.aggregate("f", F.slice("f", 1, 0), step), 1, MAX_NAMED)
    base = F.create_map(*[F.lit(v) for kv in LABEL_BASE.items() for v in kv])
    sure = lambda x: F.round(F.least(F.lit(1.0), F.coalesce(F.try_element_at(base, x["label"]) + F.least(F.lit(0.1), 0.03 * F.size(F.split(x["text"], r"\s+"))), F.lit(PATTERN_CONFIDENCE))), 6)
    return rows.select("query_id", "question", F.transform(joined, lambda x: F.struct(x["start"], x["stop"], x["text"], x["label"], sure(x).alias("confidence"))).alias("named"))


def holds(text: Column, names: Column) -> Column:
    """The names that a text contains, whatever their case."""
    return F.filter(names, lambda n: F.lower(text).contains(F.lower(n)))


def cut_once(pattern: str):
    """A text as its two groups under the pattern, or alone."""
    return lambda x: F.when(x.rlike(pattern), F.array(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2))).otherwise(F.array(x))


def parts_of(q: Column, names: Column) -> Column:
    """The question cut once at each kind of connector, fragments over five letters; of more than two the first and the
    last, unless one between holds a name."""
    parts = F.array(q)
    for pattern in SPLITS:
        parts = F.filter(F.transform(F.flatten(F.transform(parts, cut_once(r"(?is)^(.*?)" + pattern + r"(.*)$"))), strip), lambda x: F.length(x) > 5)
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    plain = (F.size(parts) > 2) & ~F.exists(middle, lambda m: F.size(holds(m, names)) > 0)
    return F.when(plain, F.array(F.element_at(parts, 1), F.element_at(parts, -1))).otherwise(parts)


def well_formed(part: Column, names: Column) -> Column:
    """A fragment can be looked up if it names an entity or asks with a question word."""
    return (F.size(holds(part, names)) > 0) | F.exists(F.regexp_extract_all(F.lower(part), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.isin(WH))


def hop(step: Column, text: Column, needs: Column, bridge: Column, targets: Column) -> Column:
    return F.struct(step.cast("int").alias("step_id"), text.alias("sub_query"), needs.cast("array<int>").alias("depends_on"), bridge.alias("is_bridge"), targets.alias("targets"))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def planned(questions: DataFrame, qid: str, text: str, names: DataFrame | None = None) -> DataFrame:
    """The plan of every question: strategy, constraints, matched pattern and its hops in order.

    Questions of several hops: an unnamed "another" thing is resolved first (J); else the question is cut at connectors,
    its fragments are turned round, and fragments without a name borrow one; where a fragment is not well formed, the first
    name is looked up before the whole question; without a name it stays one hop. Comparisons and intersections: "Are X and
    Y both P?" asks of X and of Y (I); "X or Y" asks each for the rest of the question; two names each stand in for both;
    a shared attribute is asked for directly. Every other question is one hop. ``names`` may come from a model as
    (query_id, question, named); by default they are those of ``question_names``.
    """
    found = question_names(questions, qid, text) if names is None else names
    p = classified(questions, qid, text).join(found.select("query_id", "named"), "query_id")
    q, kind, ents = F.col("question"), F.col("query_type"), F.col("named")
    p = p.withColumn("entities", F.transform(ents, lambda e: e["text"]))
    names_ = F.col("entities")
    none, no = F.array(), F.lit(False)
    both = r"(?i)^\s*(are|is|were|was|did|do|does|have|has)\s+(.+?)\s+and\s+(.+?)\s+both\s+(.+?)\s*\?*$"
    aux = F.create_map(*[F.lit(x) for kv in {"are": "Is", "were": "Was", "did": "Did", "do": "Does", "does": "Does", "have": "Has", "has": "Has", "is": "Is", "was": "Was"}.items() for x in kv])
    lead = aux[F.lower(F.regexp_extract(q, both, 1))]
    one = lambda i: F.concat_ws(" ", lead, F.regexp_extract(q, both, i), F.concat(F.regexp_extract(q, both, 4), F.lit("?")))
    another = F.concat(F.lit("Which "), F.regexp_extract(q, "(?i)" + ANOTHER, 1), F.lit(" is mentioned together with "), F.coalesce(F.try_element_at(names_, F.lit(1)), F.lit("it")), F.lit("?"))
    # comparison: the first two neighbours with "or" between them, else the first two names apart
    gap = lambda i: F.substring(q, F.try_element_at(ents, i + 1)["stop"] + 1, F.try_element_at(ents, i + 2)["start"] - F.try_element_at(ents, i + 1)["stop"])
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ents) - 2, F.lit(0))), lambda i: F.coalesce(gap(i).rlike(r"(?i)^\s*,?\s+or\s+$"), no))
    p = p.withColumn("parts", parts_of(q, names_)).withColumn("or_at", F.try_element_at(at, F.lit(1)))
    a, b = F.try_element_at(ents, F.col("or_at") + 1), F.try_element_at(ents, F.col("or_at") + 2)
    rest = squeezed(F.concat(F.substring(q, F.lit(1), a["start"]), F.lit(" "), F.substring(q, b["stop"] + 1, F.length(q))))
    rest = strip(F.regexp_replace(strip(F.regexp_replace(rest, r"\?+$", "")), r"^,+|,+$", ""))
    clause = F.regexp_replace(strip(F.regexp_replace(rest, "(?i)" + LEAD, "")), r"^[,; ]+", "")
    template = F.lit(None).cast("string")
    for pattern, ask in reversed(SHARED):
        template = F.when(like(q, pattern), ask).otherwise(template)
    ask_of = lambda e: F.replace(template, F.lit("{}"), e)
    either = lambda e: squeezed(F.when(template.isNotNull(), ask_of(e)).when(clause != "", F.concat_ws(" ", e, clause)).otherwise(F.concat(F.lit("Who is "), e, F.lit("?"))))
    first = F.try_element_at(ents, F.lit(1))
    apart = F.try_element_at(F.filter(F.slice(ents, 2, MAX_NAMED), lambda e: (e["start"] >= first["stop"]) | (e["stop"] <= first["start"])), F.lit(1))
    span = lambda e: squeezed(F.concat(F.substring(q, F.lit(1), F.least(first["start"], apart["start"])), e, F.substring(q, F.greatest(first["stop"], apart["stop"]) + 1, F.length(q))))
    side = lambda e: F.when(template.isNotNull(), ask_of(e)).when(apart.isNotNull(), span(e)).otherwise(F.concat(F.lit("What is "), e, F.lit("?")))
    # several hops: fragments from the last to the first
    parts = F.col("parts")
    n = F.size(parts)
    usable = (n > 1) & F.forall(parts, lambda x: well_formed(x, names_))
    turned = F.reverse(parts)

    def fragment(x: Column, i: Column) -> Column:
        own = holds(x, names_)
        ahead = F.slice(turned, 2, F.greatest(n - 1, F.lit(0)))
        lent = lambda pool: F.filter(names_, lambda e: F.exists(pool, lambda o: F.lower(o).contains(F.lower(e))) & ~F.lower(x).contains(F.lower(e)))
        kinds = F.filter(F.transform(ahead, lambda o: strip(F.regexp_extract(o, "(?i)" + KIND, 1))), lambda o: o != "")
        donors = F.when(F.size(lent(ahead)) > 0, F.slice(lent(ahead), 1, 2)).otherwise(F.slice(kinds, 1, 1))
        behind = F.slice(lent(F.slice(turned, 1, i)), 1, 2)
        inner = (i < n - 1) & (F.size(own) == 0) & (F.size(donors) > 0)
        vague = (i == n - 1) & (F.size(own) == 0) & like(x, VAGUE) & (F.size(behind) > 0)
        once = F.regexp_extract(x, "(?i)" + VAGUE, 1)
        swapped = F.concat(F.substring(x, F.lit(1), F.instr(x, once) - 1), F.array_join(behind, " "), F.substring(x, F.instr(x, once) + F.length(once), F.length(x)))
        full = F.when(inner, F.concat_ws(" ", F.array_join(donors, " "), x)).when(vague, swapped).otherwise(x)
        return hop(i, sub_query(full), F.when(i > 0, F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0)))).otherwise(none.cast("array<int>")), i < n - 1, own)

    multi, pair = kind == "multi_hop", kind.isin("comparison", "intersection")
    pattern = (
        F.when(multi & like(q, ANOTHER), "J_implicit_bridge").when(multi & usable, "connector_split").when(multi & (F.size(names_) > 0), "fallback_generic_2hop").when(multi, "fallback_degraded_to_single_hop")
        .when(pair & q.rlike(both), "I_boolean_conjunction").when(pair & F.col("or_at").isNotNull(), "select_between_two").when(pair & (F.size(names_) == 0), "comparison_no_entities")
        .when(pair & template.isNotNull(), "comparison_attr_map").when(pair, "comparison_parallel").otherwise("single")
    )
    p = p.withColumn("pattern", pattern)
    is_ = lambda *x: F.col("pattern").isin(*x)
    zero, one_, dep = F.lit(0), F.lit(1), F.array(F.lit(0))
    yes = F.lit(True)
    text_of = lambda e: F.array(e)
    sides = F.filter(F.array(first, apart), lambda e: e.isNotNull())
    hops = (
        F.when(is_("J_implicit_bridge"), F.array(hop(zero, another, none, yes, F.slice(names_, 1, 1)), hop(one_, q, dep, no, names_)))
        .when(is_("connector_split"), F.transform(turned, fragment))
        .when(is_("fallback_generic_2hop"), F.array(hop(zero, F.concat(F.lit("Who or what is "), F.try_element_at(names_, F.lit(1)), F.lit("?")), none, yes, F.slice(names_, 1, 1)), hop(one_, q, dep, no, names_)))
        .when(is_("I_boolean_conjunction"), F.array(hop(zero, one(2), none, no, text_of(F.regexp_extract(q, both, 2))), hop(one_, one(3), none, no, text_of(F.regexp_extract(q, both, 3)))))
        .when(is_("select_between_two"), F.array(hop(zero, either(a["text"]), none, yes, text_of(a["text"])), hop(one_, either(b["text"]), none, yes, text_of(b["text"]))))
        .when(is_("comparison_attr_map", "comparison_parallel"), F.transform(sides, lambda e, i: hop(i, side(e["text"]), none, yes, text_of(e["text"]))))
        .otherwise(F.array(hop(zero, q, none, no, names_)))
    )
    strategy = F.when((kind == "single_hop") & (F.size("entities") <= 1), "vector_only").otherwise("hybrid")
    return p.select(
        "query_id", "question", "query_type", "confidence", strategy.alias("strategy"), "entities", "pattern", hops.alias("hops"),
        F.regexp_extract_all(q, F.lit(YEAR), F.lit(1)).alias("years"), F.lower(F.regexp_extract(q, "(?i)" + TERMS, 1)).alias("temporal_relation"),
        F.when(kind == "comparison", F.when(like(q, GREATER), "greater").when(like(q, LESS), "less")).alias("direction"), F.when(kind == "comparison", F.lower(F.regexp_extract(q, "(?i)" + ATTRIBUTE, 1))).alias("attribute"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "agentic_ablation").select("question_id", "question").distinct()


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(questions(spark, sf_dir), "question_id", "question")


def question_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E34, E35, E37 over the questions, one row an entity."""
    return question_names(questions(spark, sf_dir), "question_id", "question").select("query_id", F.posexplode("named").alias("pos", "e")).select("query_id", "pos", "e.*")


def p_plan_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(questions(spark, sf_dir), "question_id", "question").select("query_id", "query_type", "confidence")


def plan_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = plans(spark, sf_dir).select("query_id", "pattern", F.inline("hops"))
    return h.select("query_id", "pattern", "step_id", "sub_query", F.array_join("depends_on", ",").alias("depends_on"), "is_bridge", F.array_join("targets", "|").alias("targets"))


def plan_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P04, P23."""
    return plans(spark, sf_dir).select("query_id", "strategy", F.array_join("years", ",").alias("years"), "temporal_relation", F.coalesce("direction", F.lit("")).alias("direction"), F.coalesce("attribute", F.lit("")).alias("attribute"))


def plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan written as one JSON text and read again, with its steps in order."""
    p = plans(spark, sf_dir)
    text = p.select("query_id", F.to_json(F.struct(*[c for c in p.columns if c != "query_id"])).alias("plan"))
    schema = "question string, query_type string, strategy string, pattern string, entities array<string>, hops array<struct<sub_query:string>>"
    r = text.select("query_id", F.from_json("plan", schema).alias("x")).select("query_id", "x.*")
    return r.select(
        "query_id", "question", "query_type", "strategy", "pattern", F.size("hops").alias("n_hops"), F.array_join("hops.sub_query", " / ").alias("sub_queries"),
        F.array_join("entities", "|").alias("entities"),
    )


QUERIES = {"e34_question_names": question_named, "plan01_class": p_plan_class, "plan06_hops": plan_hops, "plan23_constraints": plan_constraints, "plan25_json": plan_json}


def _hit(p: str) -> str:
    return f"regexp_matches(question, '(?i){p.replace(chr(39), chr(39) * 2)}')"


_CLS = "WITH q0 AS (SELECT DISTINCT question_id AS query_id, " + strip_sql("coalesce(question, '')") + " AS question FROM agentic_ablation), s0 AS (SELECT *, " + ", ".join(
    "(" + " + ".join(f"{_hit(p)}::INT" for p in ps) + f") AS s_{n}" for n, ps in FAMILIES.items()
) + f""" FROM q0), s1 AS (SELECT * REPLACE (CASE WHEN s_multi_hop > 0 AND s_temporal > s_multi_hop THEN s_temporal ELSE s_multi_hop END AS s_multi_hop) FROM s0), s2 AS (SELECT *, greatest({', '.join('s_' + n for n in FAMILIES)}) AS top FROM s1),
    cl AS (SELECT query_id, question, CASE WHEN {_hit(BOTH)} THEN 'comparison' WHEN {_hit(ANOTHER)} THEN 'multi_hop' WHEN top = 0 THEN 'single_hop' {' '.join(f"WHEN s_{n} = top THEN '{n}'" for n in FAMILIES)} END AS query_type,
        round(CASE WHEN {_hit(BOTH)} OR {_hit(ANOTHER)} THEN 0.9 WHEN top = 0 THEN 0.7 ELSE least(0.95, 0.6 + 0.15 * top) END::DOUBLE, 6) AS confidence FROM s2)"""
_S = strip_sql


def _q(x: str) -> str:
    return x.replace("'", "''")


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(?i){_q(pattern)}')"


def _holds(x: str, names: str = "nm") -> str:
    return f"list_filter({names}, lambda n: contains(lower({x}), lower(n)))"


def _cut(parts: str, pattern: str) -> str:
    once = f"'(?is)^(.*?){pattern}(.*)$'"
    return f"list_filter(list_transform(flatten(list_transform({parts}, lambda x: CASE WHEN regexp_matches(x, {once}) THEN [regexp_extract(x, {once}, 1), regexp_extract(x, {once}, 2)] ELSE [x] END)), lambda x: {_S('x')}), lambda x: length(x) > 5)"


def _ask(e: str) -> str:
    return f"replace(tp, '{{}}', {e})"


def _squeeze(x: str) -> str:
    return f"regexp_replace({_S(x)}, '\\s+', ' ', 'g')"


def _subq(x: str) -> str:
    part = f"regexp_replace({_S(x)}, '(?i){CONJ}', '')"
    return f"CASE WHEN ends_with({part}, '?') THEN {part} WHEN {_has(part, ASKS)} THEN {part} || '?' ELSE 'What is ' || {part} || '?' END"


_FOUND = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(question, '{_q(p)}', 1), lambda x: {{'text': {_S(f"regexp_replace({_S('x')}, '{OPENING}', '')")}, 'label': '{label}'}})" for p, label in NAMED) + ")"
_JOINS = f"""b[1].start >= a[-1].stop AND b[1].start - a[-1].stop <= {SHORT_GAP} AND ({_S("substring(question, a[-1].stop + 1, b[1].start - a[-1].stop)")} IN ('', '''s', '’s') OR (len(gp(question, a[-1].stop, b[1].start)) > 0 AND len(list_filter(gp(question, a[-1].stop, b[1].start), lambda t: t NOT IN ({', '.join(f"'{x}'" for x in INSIDE)}))) = 0))"""
_GP = lambda: f"list_filter(regexp_split_to_array(regexp_replace(lower({_S('substring(question, a[-1].stop + 1, b[1].start - a[-1].stop)')}), '^''+|''+$', '', 'g'), '\\s+'), lambda t: t <> '')"
_JOINS = _JOINS.replace("gp(question, a[-1].stop, b[1].start)", _GP())
_BASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABEL_BASE.items())
_NAM = f""", f1 AS (SELECT query_id, question, list_filter({_FOUND}, lambda x: length(x.text) > 2 AND lower(x.text) NOT IN ({', '.join(f"'{x}'" for x in NO_NAMES)})) AS f FROM q0),
    f2 AS (SELECT query_id, question, list_sort(list_transform(list_filter(f, lambda x, i: len(list_filter(f[1:i - 1], lambda y: lower(y.text) = lower(x.text))) = 0), lambda x: {{'start': instr(question, x.text) - 1, 'stop': instr(question, x.text) - 1 + length(x.text), 'text': x.text, 'label': x.label}})) AS f FROM f1),
    f3 AS (SELECT query_id, question, list_filter(f, lambda x: NOT (x.label = 'PROPN' AND length(x.text) < {SHORT_NAME}) AND (contains(x.text, ' ') OR len(list_filter(f, lambda y: lower(y.text) <> lower(x.text) AND contains(lower(y.text), lower(x.text)))) = 0)) AS f FROM f2),
    f4 AS (SELECT query_id, question, CASE WHEN len(f) = 0 THEN f ELSE list_reduce(list_transform(f, lambda x: [x]), lambda a, b: CASE WHEN {_JOINS} THEN list_concat(a[1:len(a) - 1], [{{'start': a[-1].start, 'stop': b[1].stop, 'text': {_S('substring(question, a[-1].start + 1, b[1].stop - a[-1].start)')}, 'label': CASE WHEN a[-1].label IN ('PROPN', 'QUOTED') AND b[1].label NOT IN ('PROPN', 'QUOTED') THEN b[1].label ELSE a[-1].label END}}]) ELSE list_concat(a, b) END) END AS f FROM f3),
    na AS (SELECT query_id, question, f[1:{MAX_NAMED}] AS ne, list_transform(f[1:{MAX_NAMED}], lambda x: x.text) AS nm FROM f4)"""
_BOTHS = r"(?i)^\s*(are|is|were|was|did|do|does|have|has)\s+(.+?)\s+and\s+(.+?)\s+both\s+(.+?)\s*\?*$"
_LEADS = "CASE lower(regexp_extract(question, '" + _BOTHS + "', 1)) WHEN 'are' THEN 'Is' WHEN 'is' THEN 'Is' WHEN 'were' THEN 'Was' WHEN 'was' THEN 'Was' WHEN 'did' THEN 'Did' WHEN 'do' THEN 'Does' WHEN 'does' THEN 'Does' ELSE 'Has' END"
_ONE = lambda i: f"{_LEADS} || ' ' || regexp_extract(question, '{_BOTHS}', {i}) || ' ' || regexp_extract(question, '{_BOTHS}', 4) || '?'"
_STRUCT = lambda i, text, needs, bridge, targets: f"{{'step_id': ({i})::INT, 'sub_query': {text}, 'depends_on': {needs}, 'is_bridge': {bridge}, 'targets': {targets}}}"
_REST = f"{_S('regexp_replace(' + _S('regexp_replace(' + _squeeze('substring(question, 1, oa.start) || ' + chr(39) + ' ' + chr(39) + ' || substring(question, ob.stop + 1)') + ', ' + chr(39) + '[?]+$' + chr(39) + ', ' + chr(39) * 2 + ')') + ', ' + chr(39) + '^,+|,+$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}"
_LENT = lambda pool, x: f"list_filter(nm, lambda e: len(list_filter({pool}, lambda o: contains(lower(o), lower(e)))) > 0 AND NOT contains(lower({x}), lower(e)))"
_AHEAD = "list_reverse(parts)[2:]"
_KINDS = f"list_filter(list_transform({_AHEAD}, lambda o: {_S(f"regexp_extract(o, '(?i){KIND}', 1)")}), lambda o: o <> '')"
_VG = f"regexp_extract(x, '(?i){VAGUE}', 1)"
_FULL = f"""CASE WHEN i < len(parts) AND len({_holds('x')}) = 0 AND (len({_LENT(_AHEAD, 'x')}) > 0 OR len({_KINDS}) > 0) THEN array_to_string(CASE WHEN len({_LENT(_AHEAD, 'x')}) > 0 THEN {_LENT(_AHEAD, 'x')}[1:2] ELSE {_KINDS}[1:1] END, ' ') || ' ' || x
    WHEN i = len(parts) AND len({_holds('x')}) = 0 AND {_has('x', VAGUE)} AND len({_LENT('list_reverse(parts)[1:i - 1]', 'x')}) > 0 THEN substring(x, 1, instr(x, {_VG}) - 1) || array_to_string({_LENT('list_reverse(parts)[1:i - 1]', 'x')}[1:2], ' ') || substring(x, instr(x, {_VG}) + length({_VG})) ELSE x END"""
_P0 = _cut(_cut("[question]", SPLITS[0]), SPLITS[1])
_NONE = "[]::INT[]"
_HOPS = _NAM + rf""", pa AS (SELECT cl.*, na.ne, na.nm, {_P0} AS p0, CASE {' '.join(f"WHEN {_has('question', p)} THEN '{t}'" for p, t in SHARED)} END AS tp, list_filter(range(1, len(ne)), lambda i: regexp_matches(substring(question, ne[i].stop + 1, ne[i + 1].start - ne[i].stop), '(?i)^\s*,?\s+or\s+$')) AS ors,
        ne[1] AS fe, list_filter(ne[2:], lambda e: e.start >= ne[1].stop OR e.stop <= ne[1].start)[1] AS ap FROM cl JOIN na USING (query_id, question)),
    pb AS (SELECT *, CASE WHEN len(p0) > 2 AND len(list_filter(p0[2:len(p0) - 1], lambda m: len({_holds('m')}) > 0)) = 0 THEN [p0[1], p0[-1]] ELSE p0 END AS parts, ne[ors[1]] AS oa, ne[ors[1] + 1] AS ob FROM pa),
    pc AS (SELECT *, len(parts) > 1 AND len(list_filter(parts, lambda x: NOT (len({_holds('x')}) > 0 OR len(list_filter(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({', '.join(f"'{x}'" for x in WH)}))) > 0))) = 0 AS usable, regexp_replace({_S(f"regexp_replace({_REST}, '(?i){LEAD}', '')")}, '^[,; ]+', '') AS clause FROM pb),
    pd AS (SELECT *, CASE WHEN query_type = 'multi_hop' AND {_has('question', ANOTHER)} THEN 'J_implicit_bridge' WHEN query_type = 'multi_hop' AND usable THEN 'connector_split' WHEN query_type = 'multi_hop' AND len(nm) > 0 THEN 'fallback_generic_2hop' WHEN query_type = 'multi_hop' THEN 'fallback_degraded_to_single_hop'
        WHEN query_type NOT IN ('comparison', 'intersection') THEN 'single' WHEN regexp_matches(question, '{_BOTHS}') THEN 'I_boolean_conjunction' WHEN len(ors) > 0 THEN 'select_between_two' WHEN len(nm) = 0 THEN 'comparison_no_entities' WHEN tp IS NOT NULL THEN 'comparison_attr_map' ELSE 'comparison_parallel' END AS pattern FROM pc),
    pe AS (SELECT *, CASE pattern
        WHEN 'J_implicit_bridge' THEN [{_STRUCT(0, f"'Which ' || regexp_extract(question, '(?i){ANOTHER}', 1) || ' is mentioned together with ' || coalesce(nm[1], 'it') || '?'", _NONE, 'TRUE', 'nm[1:1]')}, {_STRUCT(1, 'question', '[0]', 'FALSE', 'nm')}]
        WHEN 'connector_split' THEN list_transform(list_reverse(parts), lambda x, i: {_STRUCT('i - 1', _subq(_FULL), 'range(0, i - 1)::INT[]', 'i < len(parts)', _holds('x'))})
        WHEN 'fallback_generic_2hop' THEN [{_STRUCT(0, "'Who or what is ' || nm[1] || '?'", _NONE, 'TRUE', 'nm[1:1]')}, {_STRUCT(1, 'question', '[0]', 'FALSE', 'nm')}]
        WHEN 'I_boolean_conjunction' THEN [{_STRUCT(0, _ONE(2), _NONE, 'FALSE', f"[regexp_extract(question, '{_BOTHS}', 2)]")}, {_STRUCT(1, _ONE(3), _NONE, 'FALSE', f"[regexp_extract(question, '{_BOTHS}', 3)]")}]
        WHEN 'select_between_two' THEN list_transform([oa.text, ob.text], lambda e, i: {_STRUCT('i - 1', _squeeze(f"CASE WHEN tp IS NOT NULL THEN {_ask('e')} WHEN clause <> '' THEN e || ' ' || clause ELSE 'Who is ' || e || '?' END"), _NONE, 'TRUE', '[e]')})
        WHEN 'single' THEN [{_STRUCT(0, 'question', _NONE, 'FALSE', 'nm')}] WHEN 'comparison_no_entities' THEN [{_STRUCT(0, 'question', _NONE, 'FALSE', 'nm')}] WHEN 'fallback_degraded_to_single_hop' THEN [{_STRUCT(0, 'question', _NONE, 'FALSE', 'nm')}]
        ELSE list_transform(CASE WHEN ap IS NULL THEN [fe.text] ELSE [fe.text, ap.text] END, lambda e, i: {_STRUCT('i - 1', f"CASE WHEN tp IS NOT NULL THEN {_ask('e')} WHEN ap IS NOT NULL THEN {_squeeze('substring(question, 1, least(fe.start, ap.start)) || e || substring(question, greatest(fe.stop, ap.stop) + 1)')} ELSE 'What is ' || e || '?' END", _NONE, 'TRUE', '[e]')}) END AS hops FROM pd)"""
_CON = f"""array_to_string(regexp_extract_all(question, '{YEAR}', 1), ',') AS years, lower(regexp_extract(question, '(?i){TERMS}', 1)) AS temporal_relation,
            CASE WHEN query_type <> 'comparison' THEN '' WHEN {_hit(GREATER)} THEN 'greater' WHEN {_hit(LESS)} THEN 'less' ELSE '' END AS direction, CASE WHEN query_type = 'comparison' THEN lower(regexp_extract(question, '(?i){ATTRIBUTE}', 1)) ELSE '' END AS attribute"""
_STRAT = "CASE WHEN query_type = 'single_hop' AND len(nm) <= 1 THEN 'vector_only' ELSE 'hybrid' END AS strategy"
ORACLE = {
    "plan01_class": _CLS + " SELECT query_id, query_type, confidence FROM cl",
    "e34_question_names": _CLS + _NAM + f" SELECT query_id, (i - 1)::INT AS pos, e.start AS start, e.stop AS stop, e.text AS text, e.label AS label, round(coalesce(CASE e.label {_BASES} END::DOUBLE * 0 + least(1, CASE e.label {_BASES} END::DOUBLE + least(0.1::DOUBLE, 0.03::DOUBLE * len(regexp_split_to_array(e.text, '\\s+')))), 0.75), 6) AS confidence FROM (SELECT query_id, unnest(ne) AS e, generate_subscripts(ne, 1) AS i FROM na)",
    "plan06_hops": _CLS + _HOPS + " SELECT query_id, pattern, h.step_id AS step_id, h.sub_query AS sub_query, array_to_string(h.depends_on, ',') AS depends_on, h.is_bridge AS is_bridge, array_to_string(h.targets, '|') AS targets FROM (SELECT query_id, pattern, unnest(hops) AS h FROM pe)",
    "plan23_constraints": _CLS + _NAM + f" SELECT query_id, {_STRAT}, {_CON} FROM cl JOIN na USING (query_id, question)",
    "plan25_json": _CLS + _HOPS + f""" SELECT query_id, question, query_type, {_STRAT}, pattern, len(hops) AS n_hops, array_to_string(list_transform(hops, lambda h: h.sub_query), ' / ') AS sub_queries, array_to_string(nm, '|') AS entities FROM pe""",
}
