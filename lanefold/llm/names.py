"""Problem 2: variant spellings of names, by a prefix-filtered q-gram join and soft weighted token similarity.

Names become lists of plain tokens (case, accents, titles, legal marks and known short forms resolved). Distinct lists
are the classes that are compared. Distinct tokens are joined with each other on what is left of them without a letter or two,
long ones on their q-gram sets: a token's grams are ordered by their frequency, and only the rarest ones needed for the
least overlap are joined. Both ways meet every pair that ``close`` accepts. So each token learns all its near spellings.
Two classes are a candidate pair if they share a weighty token, as spelt by one of them, and a mark of another token: one
of its near spellings, its beginning, or its initial where one side has only that. Pairs are made in blocks, so no task
holds a frequent name, and each is verified on its own: the soft token similarity weighs tokens by rarity and matches
equal, misspelt, shortened, initial and acronym tokens. Links are followed from the surest kind to the weakest, and a
shortened name is only linked where its longer names are one entity.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanefold.llm.groups import connected_groups
from lanefold.operators.skew import attach, block_join
from lanefold.sources.shared import load, materialise

TYPES = ("PERSON", "ORGANIZATION")
#: tokens up to MOST_SHORTENED letters meet without some letters, from LEAST_GRAMS on by Q-grams; close tokens differ by two letters
MOST_SHORTENED, LEAST_GRAMS, Q = 18, 17, 4
KEY_SHARE = 0.6
THRESHOLD = 0.6
LONG = 9
#: classes of a block of candidate pairs, letters of an acronym
BLOCK_ROWS, ACRONYM = 500, 6

#: Forms of address, words without weight in names of organisations, legal forms, and common short forms.
TITLES = set("dr doctor prof professor rev reverend capt captain hon honourable honorable sir dame lady lord mr mrs ms miss mx fr sr jr herr frau col gen lt maj sgt phd md esq".split())
STOPS = set("of for and the de la le les du des der die das und et y e v ev hq".split())
LEGAL = set("group limited company corporation incorporated holding holdings plc llc gmbh ag sa spa nv bv".split())
SHORT_WORDS = dict(
    dept="department", univ="university", uni="university", u="university", inst="institute", assoc="association", assn="association",
    corp="corporation", co="company", cmpny="company", cie="company", ltd="limited", inc="incorporated", bros="brothers", grp="group",
    soc="society", intl="international", int="international", natl="national", nat="national", publ="publishing", pub="publishing",
    res="research", dev="development", mfg="manufacturing", ctr="center", tech="technology", hosp="hospital", lib="library", mus="museum",
    govt="government", comm="committee", fdn="foundation", acad="academy", coll="college", eng="engineering", sci="sciences",
)
NICKNAMES = dict(
    al="albert", alex="alexander", sandy="alexander", sasha="alexander", xander="alexander", andy="andrew", drew="andrew", tony="anthony",
    gus="augustus", gussie="augustus", ben="benjamin", benny="benjamin", benji="benjamin", becky="rebecca", becca="rebecca", reba="rebecca", beth="elizabeth", betty="elizabeth", liz="elizabeth",
    lizzie="elizabeth", eliza="elizabeth", bess="elizabeth", libby="elizabeth", betsy="elizabeth", bill="william", billy="william", will="william", willy="william", liam="william",
    bob="robert", bobby="robert", rob="robert", robbie="robert", charlie="charles", chuck="charles", chas="charles", cathy="katherine", kate="katherine",
    kathy="katherine", katie="katherine", kitty="katherine", kit="katherine", kay="katherine", dick="richard", rick="richard", rich="richard", ricky="richard", richie="richard", dolly="dorothy", dot="dorothy",
    dottie="dorothy", dora="dorothy", dima="dmitri", mitya="dmitri", ed="edward", eddie="edward", ned="edward", ted="theodore", teddy="theodore", theo="theodore", tedo="teodor", teo="teodor",
    etta="henrietta", hettie="henrietta", hattie="henrietta", fran="francesca", franny="francesca", cesca="francesca", frank="francis", frankie="francis", fred="frederick", freddie="frederick", freddy="frederick",
    fritz="friedrich", beppe="giuseppe", peppe="giuseppe", beppo="giuseppe", pino="giuseppe", greg="gregory", lupe="guadalupe", lupita="guadalupe", hal="henry", harry="henry", hank="henry", hans="johannes", hannes="johannes",
    nacho="ignacio", jim="james", jimmy="james", jamie="james", jem="james", jon="jonathan", jonny="jonathan", johnny="john", jack="john", jo="josephine", josie="josephine", joey="joseph", joe="joseph",
    katya="yekaterina", katja="yekaterina", len="leonard", lenny="leonard", leo="leonard", maggie="margaret", meg="margaret", peggy="margaret", peg="margaret", marge="margaret", daisy="margaret",
    mick="michael", mickey="michael", mike="michael", mikey="michael", misha="michael", nat="nathaniel", nate="nathaniel", nathan="nathaniel", pat="patricia", patty="patricia", trish="patricia", tricia="patricia",
    pippa="philippa", pip="philippa", phil="philip", sam="samuel", sammy="samuel", sue="susannah", susie="susannah", suzy="susannah", sukie="susannah", steve="stephen", tom="thomas", tommy="thomas",
    vicky="victoria", vicki="victoria", tori="victoria", vic="victor", thad="thaddeus", tad="thaddeus", dave="david", dan="daniel", matt="matthew", nick="nicholas", chris="christopher",
    jenny="jennifer", jen="jennifer", debbie="deborah", barb="barbara", sally="sarah", nell="eleanor", nora="eleanor", ellie="eleanor", molly="mary", polly="mary",
    lou="louis", lon="lorenz", renz="lorenz", vasek="vaclav", mila="jarmila", toni="anton", tosha="anton", nadya="nadia", vitya="viktor", fanny="frances", wil="wilma", minna="wilhelmina",
)
_DOTTED = regex.compile(r"\b\p{L}\.(?:\p{L}\.)+")
_CAMEL = regex.compile(r"(?<=\p{Ll}\p{Ll})(?=\p{Lu}\p{Ll})")
_MARKS, _WORD, _CAPS = regex.compile(r"\p{M}+"), regex.compile(r"[\p{L}\p{Nd}]+"), regex.compile(r"\b\p{Lu}{2,3}\b")


def tokens(name: str, kind: str) -> list[str]:
    """The plain tokens of a name, parts moved behind a comma put back in front."""
    raw = regex.sub(r"['’`´]", "", _CAMEL.sub(" ", name or ""))
    raw = regex.sub(r"\(\s*HQ\s*\)", " ", raw)
    if kind == "PERSON":
        if regex.search(r"\p{Ll}", raw):
            raw = _CAPS.sub(lambda m: " ".join(m.group()), raw)
    else:
        raw = _DOTTED.sub(lambda m: m.group().replace(".", ""), raw)
    head, comma, tail = raw.rpartition(",")
    if comma and tail.strip():
        raw = f"{tail} {head}"
    plain = _MARKS.sub("", unicodedata.normalize("NFD", raw.casefold()))
    out = []
    for w in _WORD.findall(plain):
        if regex.search(r"\p{L}", w) and regex.search(r"\p{Nd}", w):
            w = w.replace("0", "o").replace("1", "l")
        if kind == "PERSON":
            if w not in TITLES:
                out.append(NICKNAMES.get(w, w))
        elif w not in STOPS:
            out.append(SHORT_WORDS.get(w, w))
    return out


def near(a: str, b: str) -> bool:
    """Equal up to one letter added, dropped, replaced or swapped with its neighbour, or one rn/m, cl/d, vv/w, ph/f confusion."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return True
        return a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    if len(a) > len(b):
        a, b = b, a
    if a[i:] == b[i + 1 :]:
        return True
    j = max(0, i - 1)
    for at in (i, j):
        if (b[at : at + 2], a[at : at + 1]) in {("rn", "m"), ("cl", "d"), ("vv", "w"), ("ph", "f")} and b[:at] == a[:at] and b[at + 2 :] == a[at + 1 :]:
            return True
    return False


def close(a: str, b: str) -> bool:
    """Near, or two edits apart where both have at least LONG letters and begin alike; two plain replacements are too far."""
    if near(a, b):
        return True
    if min(len(a), len(b)) < LONG or abs(len(a) - len(b)) > 2 or a[0] != b[0]:
        return False
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 2:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1] <= 2


def soft(a: str, b: str, kind: str) -> float:
    """Similarity of two tokens."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return 0.7 if long[0] == short and kind == "PERSON" else 0.0
    if len(short) >= 3 and close(a, b):
        return 0.9
    if len(short) >= 3 and len(long) - len(short) >= 2 and long.startswith(short):
        return 0.85
    if kind != "PERSON" and len(short) >= 3 and long[0] == short[0] and long[-1] == short[-1] and len(long) >= len(short) + 2:
        it = iter(long)
        if all(c in it for c in short):
            return 0.8
    return 0.0


SURE, SUBSET, WEAK = 3, 2, 1
LEVELS = (SUBSET, SUBSET, WEAK, WEAK, WEAK)


def compare(x: list[str], y: list[str], kind: str, weight: dict[str, float], key: tuple[str, ...]) -> tuple[int, bool]:
    """(kind of link or 0, whether x is the less specific of the two)."""
    options = sorted(((s, -abs(i - j), i, j) for i, a in enumerate(x) for j, b in enumerate(y) if (s := soft(a, b, kind)) > 0), reverse=True)
    left, right, got = set(range(len(x))), set(range(len(y))), []
    for s, _, i, j in options:
        if i in left and j in right:
            left.discard(i), right.discard(j)
            got.append((s, x[i], y[j]))
    acronym = False
    for mine, other, xs, ys in ((left, right, x, y), (right, left, y, x)):
        if kind != "PERSON" and len(mine) == 1 and len(other) >= 2:
            (i,) = mine
            if xs[i] == "".join(ys[j][0] for j in sorted(other)):
                got += [(0.8, xs[i], xs[i])]
                mine.clear(), other.clear()
                acronym = True
                break
    if left and right or not any(a in key or b in key for s, a, b in got if s >= 0.9):
        return 0, False
    if kind == "PERSON":  # the first names stand against each other, a middle one does not stand for a first one
        first = [next((t for t in z if not any(t in (a, b) and (a in key or b in key) for _, a, b in got)), "") for z in (x, y)]
        if first[0] and first[1] and soft(first[0], first[1], kind) == 0:
            return 0, False
    elif not acronym and any(t not in LEGAL for t in [*(x[i] for i in left), *(y[j] for j in right)]):
        return 0, False
    short = x if not left else y
    total = sum(weight[t] for t in short)
    score = sum(s * min(weight[a], weight[b]) for s, a, b in got if a in weight and b in weight) / max(total, 1e-9)
    rest = [(s, a, b) for s, a, b in got if not (a in key or b in key)]
    if not rest or score < THRESHOLD and not acronym:
        return 0, False
    if acronym:
        return WEAK, len(x) < len(y)
    initials = all(len(a) == 1 or len(b) == 1 for _, a, b in rest)
    if initials and not all(len(a) == len(b) == 1 for _, a, b in rest) or initials and (left or right):
        return WEAK, sum(map(len, x)) < sum(map(len, y))
    return (SUBSET, not left) if left or right else (SURE, False)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        lists = [tokens(n, k) for n, k in zip(b["name"], b["entity_type"])]
        yield pd.DataFrame({"entity_id": b["entity_id"], "entity_type": b["entity_type"], "sig": [" ".join(x) for x in lists]})


def shortened(token: str) -> set[str]:
    """The token with up to one letter left out (two from LONG letters on), and with each pair that may be misread as one letter.

    Every edit that ``close`` accepts leaves out at most one letter of either side, so two close tokens share one of these.
    """
    once = {token[:i] + token[i + 1 :] for i in range(len(token))}
    out = {token} | once
    if len(token) >= LONG:
        out |= {t[:i] + t[i + 1 :] for t in once for i in range(len(t))}
    for two, single in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ph", "f")):
        out |= {token[:i] + single + token[i + 2 :] for i in range(len(token) - 1) if token[i : i + 2] == two}
    return out


def _shortened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b.assign(key=[list(shortened(t)) for t in b["token"]])
        yield b.explode("key")[["entity_type", "token", "key"]]


def similar_tokens(vocabulary: DataFrame) -> DataFrame:
    """(entity_type, a, b), both orders, of all different tokens of three letters or more that are close.

    Tokens of up to MOST_SHORTENED letters meet on what is left of them without one or two letters. Tokens of LEAST_GRAMS
    letters or more meet in a prefix-filtered q-gram join: two edits touch at most 2 * (Q + 1) grams, the others are shared.
    """
    words = vocabulary.select("entity_type", "token")
    short = words.where(F.length("token").between(3, MOST_SHORTENED)).mapInPandas(_shortened, "entity_type string, token string, key string")
    short = materialise(short.select("entity_type", "token", F.xxhash64("key").alias("key")), "shortened")
    a, b = (short.select("entity_type", "key", F.col("token").alias(s)) for s in "ab")
    found = a.join(b, ["entity_type", "key"]).where(F.col("a") < F.col("b")).select("entity_type", "a", "b")
    padded = F.concat(F.lit("^"), F.col("token"), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: F.substring(padded, i, F.lit(Q))))
    sets = words.where(F.length("token") >= LEAST_GRAMS).select("entity_type", "token", grams.alias("grams"))
    rows = sets.select("entity_type", "token", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    counts = rows.groupBy("entity_type", "gram").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("entity_type", "token").orderBy("n", "gram")
    ranked = rows.join(counts, ["entity_type", "gram"]).withColumn("place", F.row_number().over(order))
    shared = F.greatest(F.lit(1), F.col("size") - 2 * (Q + 1))
    prefix = materialise(ranked.where(F.col("place") <= F.col("size") - shared + 1).select("entity_type", "gram", "token"), "prefixes")
    a, b = (prefix.select("entity_type", "gram", F.col("token").alias(s)) for s in "ab")
    pairs = a.join(b, ["entity_type", "gram"]).where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 2))
    found = found.unionByName(pairs.select("entity_type", "a", "b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[[close(a, b) for a, b in zip(p["a"], p["b"])]]

    near_pairs = found.distinct().mapInPandas(verify, "entity_type string, a string, b string")
    return near_pairs.unionByName(near_pairs.select("entity_type", F.col("b").alias("a"), F.col("a").alias("b")))


def marks(x: Column, spellings: Column) -> Column:
    """(mark, short) of a token beside the key. Two tokens that ``soft`` matches share a mark where one of them comes with all
    its near spellings: equal and close ones the other's spelling, a shortened one its beginning, a contracted one its ends,
    initials and acronyms the first letter.

    Marks of a first letter count only where one of the two is an initial, or short enough for an acronym.
    """
    n = F.length(x)
    person = F.col("entity_type") == "PERSON"
    mark = lambda c, short=False: F.struct(c.alias("mark"), F.lit(short).alias("short"))
    whole = F.transform(spellings, lambda s: mark(F.concat(F.lit("="), s)))
    start = F.when(n >= 3, F.array(mark(F.concat(F.lit("^"), F.substring(x, 1, 3)))))
    ends = F.when((n >= 3) & ~person, F.array(mark(F.concat(F.lit("~"), F.substring(x, 1, 1), F.substring(x, -1, 1)))))
    first = F.array(F.struct(F.concat(F.lit("i"), F.substring(x, 1, 1)).alias("mark"), F.when(person, n == 1).otherwise(n.between(2, ACRONYM)).alias("short")))
    none = F.array().cast("array<struct<mark:string,short:boolean>>")
    return F.concat(whole, F.coalesce(start, none), F.coalesce(ends, none), first)


def candidate_pairs(listed: DataFrame) -> DataFrame:
    """(entity_type, a, spelling_a, b, spelling_b): distinct pairs of classes with the spellings of the key token they share.

    ``listed``: entity_type, sig, t (tokens), top (greatest weight), w (token to weight and near spellings).
    """
    keyed = listed.select("entity_type", "sig", "t", "w", "top", F.explode(F.array_distinct("t")).alias("spelling"))
    keyed = keyed.where((F.col("w")[F.col("spelling")]["weight"] >= F.col("top") * KEY_SHARE) & (F.length("spelling") > 2))
    others = F.array_distinct(F.filter("t", lambda x: x != F.col("spelling")))
    near = lambda x: F.array_union(F.array(x), F.col("w")[x]["near"])
    keys = ["entity_type", "key", "mark"]
    # one side stands with its tokens as they are spelt, the other with all their near spellings
    own = keyed.select("entity_type", F.col("spelling").alias("key"), F.col("sig").alias("x"), F.col("spelling").alias("spelling_x"), F.explode(F.array_distinct(F.flatten(F.transform(others, lambda x: marks(x, F.array(x)))))).alias("m"))
    own = own.select("entity_type", "key", "m.mark", "x", "spelling_x", F.col("m.short").alias("short_x"))
    every = keyed.select("entity_type", F.col("sig").alias("y"), F.col("spelling").alias("spelling_y"), near(F.col("spelling")).alias("near"), F.explode(F.array_distinct(F.flatten(F.transform(others, lambda x: marks(x, near(x)))))).alias("m"))
    every = every.select("entity_type", F.explode("near").alias("key"), "m.mark", "y", "spelling_y", F.col("m.short").alias("short_y"))
    met = block_join(own, every, keys, "x", "y", BLOCK_ROWS).where((F.col("x") != F.col("y")) & (~F.col("mark").startswith("i") | F.col("short_x") | F.col("short_y")))
    turned = F.col("x") > F.col("y")
    pick = lambda p, q, name: F.when(turned, F.col(q)).otherwise(F.col(p)).alias(name)
    return met.select("entity_type", pick("x", "y", "a"), pick("spelling_x", "spelling_y", "spelling_a"), pick("y", "x", "b"), pick("spelling_y", "spelling_x", "spelling_b")).distinct()


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        out = []
        for kind, a, sa, wa, b, sb, wb in p[["entity_type", "a", "spelling_a", "weights_a", "b", "spelling_b", "weights_b"]].itertuples(index=False, name=None):
            x, y = a.split(" "), b.split(" ")
            weight = dict(zip(x, map(float, wa))) | dict(zip(y, map(float, wb)))
            link, less = compare(x, y, kind, weight, (sa, sb))
            if link:
                out.append((kind, *((a, b) if less else (b, a)), link))
        yield pd.DataFrame(out, columns=["entity_type", "less", "more", "link"])


def verified_links(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """(less, more, link) of the pairs that ``compare`` links, the surest link of each; names are tagged with their type."""
    side = lambda s: listed.select("entity_type", F.col("sig").alias(s), F.col("weights").alias(f"weights_{s}"))
    judged = pairs.join(side("a"), ["entity_type", "a"]).join(side("b"), ["entity_type", "b"]).mapInPandas(_judged, "entity_type string, less string, more string, link int")
    tag = lambda c: F.concat_ws("\u0001", "entity_type", c)
    tagged = judged.select(tag("less").alias("less"), tag("more").alias("more"), "link")
    best = tagged.groupBy(F.least("less", "more").alias("x"), F.greatest("less", "more").alias("y")).agg(F.max(F.struct("link", "less", "more")).alias("l"))
    return best.select("l.less", "l.more", "l.link")


def merged(links: DataFrame) -> DataFrame:
    """(id, group_id) of linked names: the sure links' groups, then in LEVELS passes the group of a shortened name joins that of
    its longer names where these are one group. Passes work on one row a sure group, so a large group is not moved about."""
    sure = connected_groups(links.where(F.col("link") == SURE), "less", "more")
    weak = links.where(F.col("link") != SURE)
    ids = links.select(F.explode(F.array("less", "more")).alias("id")).distinct()
    base = materialise(ids.join(sure, "id", "left").select("id", F.coalesce("group_id", "id").alias("g")), "sure-groups")
    less, more = base.select(F.col("id").alias("less"), F.col("g").alias("a")), base.select(F.col("id").alias("more"), F.col("g").alias("b"))
    steps = materialise(weak.join(less, "less").join(more, "more").where(F.col("a") != F.col("b")).select("link", "a", "b").distinct(), "weak-links")
    now = steps.select(F.explode(F.array("a", "b")).alias("g")).distinct().withColumn("to", F.col("g"))
    for level in LEVELS:
        a, b = now.select(F.col("g").alias("a"), F.col("to").alias("here")), now.select(F.col("g").alias("b"), F.col("to").alias("there"))
        moves = steps.where(F.col("link") == level).join(a, "a").join(b, "b").where(F.col("here") != F.col("there")).groupBy("here").agg(F.min("there").alias("there"), F.max("there").alias("last"))
        moves = materialise(moves.where(F.col("there") == F.col("last")).select("here", "there"), "moves")
        if moves.isEmpty():
            continue
        # a longer name's group may itself move on; of two that would move to each other the greater one does
        ahead = moves.select(F.col("here").alias("there"), F.col("there").alias("next"))
        moves = moves.join(ahead, "there", "left").where(F.col("next").isNull() | (F.col("next") != F.col("here")) | (F.col("here") > F.col("there")))
        moves = moves.select(F.col("here").alias("to"), F.when(F.col("next") == F.col("here"), F.col("there")).otherwise(F.coalesce("next", "there")).alias("moved"))
        now = materialise(now.join(moves, "to", "left").select("g", F.coalesce("moved", "to").alias("to")), "group-moves")
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(now, "g", "left")
    return attach(base, materialise(sizes, "group-sizes"), "g", "n", base.count()).select("id", F.coalesce("to", "g").alias("group_id"))


def variant_groups(entities: DataFrame) -> DataFrame:
    """(entity_id, group_id) for every entity_id of TYPES that shares its group with another one.

    Rows with a null id, type or name, names without a letter or digit and other types take no part; repeated rows count
    once, and where one id has several names, all of them stand for it. group_id is the group's smallest entity_id. An
    empty table gives no rows.
    """
    rows = entities.where(F.col("entity_type").isin(*TYPES) & F.col("entity_id").isNotNull() & F.col("name").isNotNull())
    named = materialise(rows.select("entity_id", "entity_type", "name").distinct().mapInPandas(_split, "entity_id string, entity_type string, sig string").where("sig <> ''").distinct(), "names")
    classes = named.groupBy("entity_type", "sig").agg(F.min("entity_id").alias("first"))
    classes = materialise(classes, "classes")
    words = materialise(classes.select("entity_type", "sig", F.explode(F.array_distinct(F.split("sig", " "))).alias("token")), "words")
    vocabulary = materialise(words.groupBy("entity_type", "token").agg(F.count(F.lit(1)).alias("df")), "vocabulary")
    pairs = similar_tokens(vocabulary)
    other = vocabulary.select("entity_type", F.col("token").alias("b"), F.col("df").alias("df_b"))
    best = pairs.join(other, ["entity_type", "b"]).groupBy("entity_type", F.col("a").alias("token")).agg(F.max("df_b").alias("df_b"), F.collect_set("b").alias("near"))
    known = vocabulary.join(best, ["entity_type", "token"], "left").select(
        F.concat_ws("\u0001", "entity_type", "token").alias("word"), "df",
        F.coalesce("near", F.array().cast("array<string>")).alias("near"), F.greatest("df", F.coalesce("df_b", "df")).alias("soft_df"),
    )
    known = materialise(known, "spellings")
    n = classes.count()
    weighed = attach(words.withColumn("word", F.concat_ws("\u0001", "entity_type", "token")), known, "word", "df", words.count())
    weighed = weighed.withColumn("weight", F.when(F.length("token") == 1, 0.5).otherwise(F.log(F.lit(float(n + 1)) / F.col("soft_df")) + 0.1))
    per = weighed.groupBy("entity_type", "sig").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("weight", "near")))).alias("w"), F.max("weight").alias("top"))
    parts = F.split("sig", " ")
    listed = materialise(per.select("entity_type", "sig", "top", "w", parts.alias("t"), F.transform(parts, lambda x: F.col("w")[x]["weight"]).alias("weights")), "name-weights")
    links = materialise(verified_links(candidate_pairs(listed), listed), "name-links")
    groups = merged(links)
    sig = F.concat_ws("\u0001", "entity_type", "sig")
    grouped = named.select("entity_id", sig.alias("sig")).join(groups.withColumnRenamed("id", "sig"), "sig", "left").select("entity_id", F.coalesce("group_id", "sig").alias("g"))
    smallest = grouped.groupBy("g").agg(F.min("entity_id").alias("group_id"), F.countDistinct("entity_id").alias("n")).where("n > 1")
    return grouped.join(smallest, "g").select("entity_id", "group_id").distinct()


def variant_pairs(groups: DataFrame) -> DataFrame:
    """All pairs (entity_id_a, entity_id_b), a < b, of the members of each group; a large group is paired in blocks."""
    a, b = (groups.select("group_id", F.col("entity_id").alias(f"entity_id_{s}")) for s in "ab")
    return block_join(a, b, ["group_id"], "entity_id_a", "entity_id_b").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(load(spark, sf_dir, "extracted_entities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(materialise(p2_groups(spark, sf_dir), "variants"))


QUERIES = {"p2_groups": p2_groups, "p2_found": p2_found}
ORACLE: dict[str, str] = {}
