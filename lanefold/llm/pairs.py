"""Problem 1: broken prompt and response pairs, by a conditional random field over the clauses of a response.

A response is cut into clauses; each gets features from the question and gold answer at hand (wording shared with the
question, words of declining, function words of a dozen languages and the script, how it ends) and from the whole table
(how often responses of the same masked wording go on after this point, instead of ending). A linear-chain CRF tags the
clauses as answer, refusal, echo, foreign or unfinished, and the share of words under each tag gives the pair's defect.

There are no labelled rows, so the CRF learns from pairs of a bounded sample whose tags are known by the way they come
about, not by its features: sound responses (those that hold the gold answer, and those worded like one that does) are
answers; the same responses broken off at a random letter are unfinished at the end; questions retyped with slips are
echoes; responses to questions in another language, with the names exchanged, or put into another script, are foreign;
sentences of declining that answer many different questions without a value of their own are refusals. Sound responses
that end as a broken one does to the first model are left out, and a second one is trained.
"""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.llm.planted import Donors, sequences, wordy
from lanefold.operators.skew import attach, extension_sums
from lanefold.sources.shared import load, materialise

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
SAMPLE_ROWS = 10_000
EPOCHS, RATE, DECAY = 300, 0.1, 1e-5
#: a response's clauses enter training in runs of at most RUN; shares of words from which a tag is the pair's defect
RUN, ECHO_SHARE, FOREIGN_SHARE, REFUSAL_SHARE = 12, 0.999, 0.5, 0.5

#: Frequent function words by language, words of declining, and strings that stand for no answer.
LANGUAGES = {
    "en": "the a an of in to and is was were are it that this for on with as by at from who which what when where how did does do not no yes i am be been has have had their its his her they he she we you but or both same would could can before after first most likely according said so there my me because although while since however whose also then than if into about only other answer text passage passages document documents source name names named says states".split(),
    "de": "der die das den dem des ein eine einen einem einer und ist war wurde waren sind in im am an auf mit von vom zu zum zur für nicht kein keine es er sie ich wir ihr sein hat hatte haben wird werden dass als auch nach bei aus über wer was wann wo welche welcher welchem wie laut steht heißt beide ja nein so dazu darüber leider weil während obwohl denn wenn ob deren dessen noch nur antwort text dokument dokumenten quelle genannt handelt niemand anderen".split(),
    "fr": "le la les l un une des du de d et est était fut a été en au aux à dans par pour sur avec sans il elle ils ce cette c qui que quoi quel quelle où quand comment ne pas je nous vous son sa ses se s selon d'après oui non les deux y ont sont sais peux aucune aucun parce lorsque quand puis où réponse texte document documents passage premier deuxième trouve agit nommé selon".split(),
    "es": "el la los las un una unos de del y es era fue en a al por para con sin que qué quién cuándo dónde cómo cuál no sí se su sus lo le yo nosotros según está este esta como más también los dos ha han son sé puedo sobre nada hay porque aunque mientras cuando respuesta texto documento documentos pasaje fuente dice indica trata primer segundo".split(),
    "pt": "o os as um uma de do da dos das e é foi em no na nos nas por para com sem que quem quando onde como não sim se seu sua segundo trata ao à isso ele ela são está mais também ambos resposta aqui porque embora quando texto documento fonte acordo diz indica".split(),
    "it": "il lo la i gli le un uno una di del della dei delle dello e è fu era in nel nella al alla per con senza che chi quando dove come non sì si suo sua secondo tratta questo questa sono ha più anche entrambi da dal dalla risposta dice tutti due perché mentre quando testo documento documenti fonte brano passo come".split(),
    "nl": "de het een van en is was in op te met voor niet geen dat die dit er hij zij ze ik wij zijn haar wordt werd werden naar bij uit over wie wat wanneer waar hoe ja nee volgens zoals staat allebei beide ook om aan antwoord als bron omdat terwijl tekst bron antwoord gaat zegt".split(),
    "sv": "och att det som en ett är var i på av för med till den de inte jag han hon vi om från enligt svaret båda ja nej har hade blev".split(),
    "da": "og at det som en et er var i på af for med til den de ikke jeg han hun vi om fra ifølge svaret begge ja nej har havde blev".split(),
    "no": "og at det som en et er var i på av for med til den de ikke jeg han hun vi om fra ifølge svaret begge ja nei har hadde ble".split(),
    "pl": "i w na z do nie to jest był była było się że jak po od przez dla według tak oba obie odpowiedź jego jej który która są co kto".split(),
    "cs": "a v na z do ne to je byl byla bylo se že jak po od pro podle ano oba odpověď jeho její který která jsou co kdo".split(),
    "tr": "ve bir bu da de için ile olarak göre evet hayır değil cevap her ikisi kim ne olan".split(),
    "fi": "ja on oli ei se että joka mukaan kyllä molemmat vastaus hän tämä".split(),
    "ro": "și este a fost în la de cu pe nu un o care din pentru conform da ambele răspunsul lui ei".split(),
    "hu": "a az és nem egy hogy volt szerint igen mindkettő válasz van ez".split(),
}
WORDS = {w: [lang for lang in LANGUAGES if w in set(LANGUAGES[lang])] for lang in LANGUAGES for w in LANGUAGES[lang]}
REFUSALS = regex.compile(
    r"\b(?:can ?not|can'?t|could not|couldn'?t|unable to|not able to|impossible to|not possible to|(?:do|does|did)(?: not|n'?t) (?:know|contain|provide|mention|say|state|specify|have|give)|"
    r"no (?:answer|information|mention|evidence|data|details?|idea|way to)|insufficient|not enough|not (?:mentioned|stated|given|provided|found|available|known)|decline|refuse|"
    r"silent (?:on|about)|(?:would )?need more|more (?:details|context|information)|says? nothing|tells? me about|nothing (?:in|about|on)|none of the|leave this open|consult another|language model|"
    r"(?:i'?m|i am)? ?sorry|unfortunately|i (?:won'?t|will not)|unclear|"
    r"wei(?:ß|ss) (?:es |ich )?(?:leider )?(?:nicht|keine)|(?:kann|können|konnte)\b.{0,60}\b(?:nicht|keine?)|keine (?:angaben?|auskunft|antwort|informationen?)|steht (?:dazu |darüber )?nichts|nichts (?:darüber|dazu)|lässt sich .{0,60}nicht|leider|tut mir leid|nicht (?:bestimmen|beantworten|bekannt|erwähnt)|geht .{0,40}nicht hervor|"
    r"ne (?:sais|peux|peut|puis|précise|permet|mentionne|dit|contient|connais|dispose)\b.{0,60}?\b(?:pas|rien|aucun)|ne .{0,30} pas|désolée?|aucune? (?:information|réponse|mention|donnée)|impossible de|"
    r"no (?:puedo|lo sé|sé|se puede|lo menciona|menciona|hay (?:información|datos|respuesta)|contiene|dispongo|tengo)|lo siento|no es posible|no aparece|desconozco|"
    r"não (?:sei|posso|há)|non (?:so|posso)|niet (?:bekend|weten)|weet (?:het )?niet)\b",
    regex.IGNORECASE,
)
PLACEHOLDERS = regex.compile(
    r"^(?:n\.?/?a\.?|null|none|nil|nan|na|undefined|unknown|not (?:specified|applicable|available)|no answer|no response|empty|blank|tbd|todo|missing|"
    r"answers?|antwort|réponse|respuesta|a|q|response|output|result|question|final answer)?\s*[:=]?\s*$",
    regex.IGNORECASE,
)
NOISE = regex.compile(r"<\|?/?[\w ]{0,40}/?\|?>|\[/?(?:INST|PAD|UNK|EOS|BOS|SEP|CLS|MASK)\]|```\w*|\\[nrt]|&\w{2,6};|[\p{Cf}\p{Cc}]", regex.IGNORECASE)
ERRORS = regex.compile(r"^\W*(?:(?:runtime|value|type|key|http|timeout|connection|api|internal server)?\s*(?:error|exception)|traceback|timeout)\b(?=\W|$)", regex.IGNORECASE)
LABEL = regex.compile(r"^\s*[\"'“«]?\s*(?:question|frage|pregunta|answer|antwort|réponse|respuesta|q|a|response)\s*[:=]\s*", regex.IGNORECASE)
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_PIECE = regex.compile(r"[\p{L}\p{M}\p{Nd}]+|[^\w\s]")
_CUT = regex.compile(r"(?<=[.!?;。！？；])\s+|\n+|(?<=[,:，：])\s+|(?<=[。！？])")
YES_NO = set("yes no ja nein oui non sí si".split())
LINKERS = set("of the for and de du des la le les el los del der die das und y et e".split())
#: Words that open a further clause.
HANGERS = set("and but or who which that where when while because although also und aber oder der die das wo weil obwohl et mais ou qui que où y pero o quien donde e".split())
LATIN = regex.compile(r"\p{Latin}")
OTHER_SCRIPT = regex.compile(r"(?V1)[\p{L}--\p{Latin}]")
OPEN_END, DOTS_END, WORD_END = regex.compile(r"[.!?…。！？)\]\"”»']\s*$"), regex.compile(r"\w\s*(?:\.\.+|…)$"), regex.compile(r"[\p{L}\p{Nd}]\s*$")
END_MARKS = regex.compile(r"[\s.!?…,;:\"'”»)\]]+$")


def _plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def content(answer: str | None) -> str:
    """The response without mark-up and invisible characters; empty for placeholders, stray marks and error messages."""
    text = NOISE.sub(" ", _plain(answer or "")).strip()
    if not _WORD.search(text) or ERRORS.match(text):
        return ""
    bare = regex.sub(r"^[\W_]+|[^\w.:=/]+$", "", text)
    return "" if PLACEHOLDERS.match(bare.rstrip(" .")) or PLACEHOLDERS.match(bare) else text


def _named(text: str) -> set[str]:
    """Lower-cased words of a text that look like names or numbers: capitalised within it, or with digits."""
    words = _WORD.findall(text)
    return {w.lower() for i, w in enumerate(words) if w[0].isdigit() or (w[0].isupper() and (i > 0 or w.lower() not in WORDS))}


def template(question: str, gold: str, text: str) -> str:
    """The response's wording with names and numbers masked, lower-cased, without end marks."""
    asked, known = _named(question), _named(gold)
    out: list[str] = []
    pieces = _PIECE.findall(text)
    bare = OTHER_SCRIPT.search(text) is None and not any(w.lower() in WORDS for w in pieces)  # nothing but names
    for i, w in enumerate(pieces):
        low = w.lower()
        inner = i > 0 or pieces[1:2] and pieces[1][0].isupper()  # a first word is a name only beside another capitalised one
        if low in asked:
            slot = "Q"
        elif low in known or w[0].isdigit() or (bare and w[0].isalpha()) or (inner and w[0].isupper() and low not in WORDS):
            slot = "D" if w[0].isdigit() else "N"
        else:
            slot = low
        if not (out and slot in ("Q", "N", "D") and out[-1] == slot):
            out.append(slot)
    return END_MARKS.sub("", " ".join(out))


def similar(a: str, b: str) -> bool:
    """Equal but for one or two letters in longer words."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or max(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 2


def alike(word: str, pool: set[str]) -> bool:
    """Whether the word or one similar to it is in the pool; similar words share their first or last letter."""
    if word in pool:
        return True
    n, a, z = len(word), word[0], word[-1]
    return n > 2 and any((x[0] == a or x[-1] == z) and -2 < len(x) - n < 2 and similar(word, x) for x in pool)


def language(words: list[str]) -> str:
    """The language whose function words the text holds most of; English where undecided."""
    score = dict.fromkeys(LANGUAGES, 0.0)
    for w in words:
        for lang in WORDS.get(w, ()):
            score[lang] += 1 / len(WORDS[w]) ** 0.5
    return max(score, key=lambda x: score[x]) if words else "en"


def question_language(question: str) -> str:
    named = _named(question)
    words = [w.lower() for w in _WORD.findall(question)]
    score = language([w for w in words if w not in named])
    return score if score in ("en", "de", "fr", "es") or not regex.search(r"\p{Latin}", question) else max(
        ("en", "de", "fr", "es"), key=lambda x: sum(x in WORDS.get(w, ()) for w in words)
    )


FEATURES = [
    "bias", "refusal_cue", "two_refusal_cues", "cue_elsewhere", "has_value", "value_elsewhere", "gold_here",
    "copy_all", "copy_most", "copy_some", "question_covered", "rest_beside_copy",
    "foreign_script", "foreign_words", "foreign_only", "own_words", "foreign_elsewhere", "no_function_words",
    "last", "open_end", "comma_end", "function_end", "cut_word", "goes_on", "mostly_goes_on", "ends_here", "single",
    "whole_name", "ellipsis_end", "open_bracket", "hanging", "stub_end", "answer_after_copy", "mostly_foreign", "mostly_own",
    "yes_or_no",
]
NUMBER = {f: i for i, f in enumerate(FEATURES)}


def clauses(question: str, gold: str, text: str, n_end: int, n_ext: int) -> tuple[np.ndarray, np.ndarray]:
    """(clauses x features, words per clause) of a response with content."""
    text = LABEL.sub("", text)
    parts = [p for p in _CUT.split(text) if p and _WORD.search(p)] or [text]
    q_words = [w.lower() for w in _WORD.findall(question)]
    q_set, q_named = set(q_words), _named(question)
    g_words = [w.lower() for w in _WORD.findall(gold)]
    own = question_language(question)
    rows, sizes, info = [], [], []

    def free_words(words: list[str], low: list[str]) -> list[str]:
        """Words that are no names, numbers or gold words, lower-cased."""
        plain = [i for i, (w, raw) in enumerate(zip(low, words)) if w not in q_named and not raw[0].isdigit() and w not in g_words]
        small = any(words[i][0].islower() for i in plain)
        inside = lambda i: 0 < i < len(words) - 1 and not words[i - 1][0].islower() and not words[i + 1][0].islower()
        return [low[i] for i in plain if (words[i][0].islower() and not inside(i)) or (i == 0 and small) or not LATIN.match(words[i][0])]

    latin_question = OTHER_SCRIPT.search(question) is None
    split = [(p, _WORD.findall(p)) for p in parts]
    frees = [free_words(words, [w.lower() for w in words]) for _, words in split]
    cover = dict.fromkeys(LANGUAGES, 0)
    for free in frees:
        for w in free:
            for lang in WORDS.get(w, ()):
                cover[lang] += 1
    alien = max((lang for lang in LANGUAGES if lang != own), key=lambda x: cover[x])
    if cover[alien] - cover[own] < 2:
        alien = None  # words shared with the question's language count for it
    for (p, words), free in zip(split, frees):
        low = [w.lower() for w in words]
        copied = [alike(w, q_set) for w in low]
        masked = " ".join(w for w in p.split() if not all(x.lower() in q_named for x in _WORD.findall(w)) or not _WORD.search(w))
        mine = sum(own in WORDS.get(w, ()) and alien not in WORDS.get(w, ()) for w in free)
        held = Counter(lang for w in free for lang in WORDS.get(w, ()) if lang != own and (lang == alien or own not in WORDS[w]))
        others = max(held.values(), default=0)
        script = latin_question and OTHER_SCRIPT.search(p) is not None
        cues = REFUSALS.findall(masked)
        new = [w not in q_set and w not in YES_NO for w in low]
        capital = [raw[0].isupper() and n and w not in WORDS for raw, w, n in zip(words, low, new)]
        value = any(n and (raw[0].isdigit() or w in g_words) for raw, w, n in zip(words, low, new))
        value = value or any(a and b for a, b in zip(capital, capital[1:])) or (len(words) == 1 and any(capital) and not cues)
        nominal = bool(words) and not cues and all(not raw[0].islower() or w in LINKERS for raw, w in zip(words, low)) and words[-1].lower() not in LINKERS
        value = value or (nominal and (any(new) or len(parts) > 1))
        yes = len(low) == 1 and low[0] in YES_NO or low[-1:] and low[-1] in YES_NO and not cues
        info.append({"low": low, "copied": copied, "mine": mine, "others": others, "script": script, "value": bool(value or yes), "cues": len(cues), "free": free, "end": p.rstrip()[-1:]})
        sizes.append(max(1, len(words)))
    every = [c for x in info for c in x["copied"]]
    answered = {w for x in info for w in x["low"]}
    covered = sum(alike(w, answered) for w in q_words) / max(1, len(q_words))
    end = text.rstrip()
    last_word = info[-1]["low"][-1] if info[-1]["low"] else ""
    raw_last = _WORD.findall(end)[-1] if _WORD.findall(end) else ""
    known = set(q_words) | set(g_words)
    cut = (
        bool(raw_last) and end.endswith(raw_last) and last_word not in known and (last_word not in WORDS or raw_last[0].isupper() and len(every) > 1)
        and any(len(w) > len(last_word) and w.startswith(last_word) for w in known) and (len(last_word) > 1 or len(every) > 1)
    )
    cut = cut and last_word not in YES_NO
    tail = info[-1]["low"]
    flat = [w for x in info for w in x["low"]]
    proper = [raw for raw in _WORD.findall(text)]
    whole = bool(flat) and not proper[-1][0].islower() and all(not raw[0].islower() or w in LINKERS for raw, w in zip(proper, flat)) and flat[-1] not in LINKERS and any(
        seq[i : i + len(flat)] == flat and not (i + len(flat) < len(seq) and (seq[i + len(flat)] in ("of", "&") or raws[i + len(flat)][0].isupper()))
        for seq, raws in ((q_words, _WORD.findall(question)), (g_words, _WORD.findall(gold))) for i in range(len(seq) - len(flat) + 1)
    )
    opened = text.count("(") > text.count(")") or text.count("[") > text.count("]") or text.count('"') % 2 or text.count("“") > text.count("”") or text.count("«") > text.count("»")
    hanging = len(info) > 1 and len(tail) <= 3 and WORD_END.search(end) is not None and (
        tail[0] in HANGERS or (tail[-1].isdigit() and len(tail) == 1 and len(tail[0]) < 3 and info[-2]["end"] == ",")
    )
    stub = len(every) > 1 and end.endswith(raw_last) and raw_last[:1].isupper() and len(raw_last) <= 3 and last_word not in known and not raw_last.isupper()
    ratio = len(every) / max(1, len(q_words))
    n_cued, n_valued = sum(x["cues"] > 0 for x in info), sum(x["value"] for x in info)
    n_alien = sum(x["script"] or x["others"] > x["mine"] for x in info)
    copied_all = all(every)
    for k, x in enumerate(info):
        f = np.zeros(len(FEATURES))
        on = lambda name, yes=True, f=f: f.__setitem__(NUMBER[name], float(bool(yes)))
        final = k == len(info) - 1
        share = sum(x["copied"]) / max(1, len(x["copied"]))
        on("bias"), on("single", len(info) == 1), on("yes_or_no", all(w in YES_NO for w in x["low"]))
        on("refusal_cue", x["cues"]), on("two_refusal_cues", x["cues"] > 1), on("cue_elsewhere", n_cued > (x["cues"] > 0))
        on("has_value", x["value"]), on("value_elsewhere", n_valued > x["value"]), on("gold_here", g_words and all(w in x["low"] for w in g_words))
        on("copy_all", share == 1), on("copy_most", share >= 0.8), on("copy_some", share >= 0.5), on("question_covered", covered >= 0.75), on("rest_beside_copy", not copied_all)
        foreign = x["script"] or x["others"] > x["mine"]
        on("answer_after_copy", copied_all and 1.12 < ratio < 1.75), on("mostly_foreign", x["others"] >= 2 and x["others"] >= 2 * x["mine"]), on("mostly_own", x["mine"] > x["others"])
        on("foreign_script", x["script"]), on("foreign_words", foreign), on("foreign_only", x["mine"] == 0 and x["others"] >= 1), on("own_words", x["mine"] > 0)
        on("foreign_elsewhere", n_alien > foreign), on("no_function_words", x["mine"] + x["others"] == 0 and not x["script"])
        if final:
            on("last")
            on("open_end", not OPEN_END.search(end))
            on("comma_end", end[-1:] in ",;:-–—(")
            on("function_end", end.endswith(raw_last) and len(every) > 1 and last_word in WORDS and last_word not in YES_NO and last_word not in {"it", "both", "so", "there", "me", "first", "dazu"} and own in WORDS[last_word])
            on("whole_name", whole), on("cut_word", cut), on("ellipsis_end", DOTS_END.search(end) is not None), on("open_bracket", opened), on("hanging", hanging), on("stub_end", stub)
            going = n_ext / max(1, n_ext + n_end)
            on("goes_on", n_ext >= 3 and going >= 0.5), on("mostly_goes_on", n_ext >= 5 and going >= 0.8), on("ends_here", n_end >= 3 and going < 0.3)
        rows.append(f)
    return np.array(rows), np.array(sizes, float)


class ClauseCRF:
    """Linear-chain CRF over clause features."""

    def __init__(self):
        self.w = np.zeros((len(FEATURES), len(TAGS)))
        self.t = np.zeros((len(TAGS), len(TAGS)))

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray]) -> ClauseCRF:
        """Maximum likelihood by adaptive gradient steps over the distinct sequences, weighted by their number."""
        distinct: dict[bytes, list] = {}
        for x, y in zip(xs, ys):
            distinct.setdefault(x.tobytes() + y.tobytes(), [x, y, 0])[2] += 1
        groups: dict[int, list] = {}
        for row in distinct.values():
            groups.setdefault(len(row[0]), []).append(row)
        batches = [(np.stack([r[0] for r in g]), np.stack([r[1] for r in g]), np.array([float(r[2]) for r in g])) for g in groups.values()]
        n = max(1.0, sum(c.sum() for _, _, c in batches))
        mw, mt, vw, vt = np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.w), np.zeros_like(self.t)
        for step in range(1, EPOCHS + 1):
            gw, gt = -DECAY * self.w, -DECAY * self.t
            for x, y, c in batches:
                score = x @ self.w
                steps = x.shape[1]
                alpha = [score[:, 0]]
                for k in range(1, steps):
                    alpha.append(score[:, k] + _lse(alpha[-1][:, :, None] + self.t[None], 1))
                beta = [np.zeros_like(score[:, 0])]
                for k in range(steps - 2, -1, -1):
                    beta.insert(0, _lse(self.t[None] + (score[:, k + 1] + beta[0])[:, None, :], 2))
                z = _lse(alpha[-1], 1)
                for k in range(steps):
                    p = np.exp(alpha[k] + beta[k] - z[:, None])
                    gw = gw + x[:, k].T @ ((np.eye(len(TAGS))[y[:, k]] - p) * c[:, None]) / n
                    if k:
                        both = np.exp(alpha[k - 1][:, :, None] + self.t[None] + (score[:, k] + beta[k])[:, None, :] - z[:, None, None])
                        seen = np.zeros_like(self.t)
                        np.add.at(seen, (y[:, k - 1], y[:, k]), c)
                        gt = gt + (seen - (both * c[:, None, None]).sum(0)) / n
            mw, mt = 0.9 * mw + 0.1 * gw, 0.9 * mt + 0.1 * gt
            vw, vt = 0.999 * vw + 0.001 * gw**2, 0.999 * vt + 0.001 * gt**2
            scale = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            self.w, self.t = self.w + scale * mw / (np.sqrt(vw) + 1e-8), self.t + scale * mt / (np.sqrt(vt) + 1e-8)
        return self

    def tag(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.w
        best, back = score[0], []
        for k in range(1, len(x)):
            options = best[:, None] + self.t
            back.append(options.argmax(0))
            best = options.max(0) + score[k]
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def defect(question: str, gold: str, answer: str | None, n_end: int, n_ext: int, crf: ClauseCRF) -> str | None:
    """The defect of a pair by the share of its response's words under each tag, or None."""
    text = content(answer)
    if not text:
        return "empty"
    f, sizes = clauses(question, gold, text, n_end, n_ext)
    share = np.bincount(crf.tag(f), sizes, len(TAGS)) / sizes.sum()
    if share[ECHO] >= ECHO_SHARE:
        return "question_copy"
    if share[FOREIGN] >= FOREIGN_SHARE:
        return "wrong_language"
    if share[UNFINISHED] > 0:
        return "truncated"
    if share[REFUSAL] >= REFUSAL_SHARE:
        return "refusal"
    return None


COLUMNS = ("question", "gold_answer", "predicted_answer")


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [content(a) for a in b["predicted_answer"]]
        t = [template(q or "", g or "", LABEL.sub("", x)) if x else "" for q, g, x in zip(b["question"], b["gold_answer"], texts)]
        yield b.assign(template=t)


def with_endings(pairs: DataFrame) -> DataFrame:
    """pairs with template, n_end (responses of just this masked wording) and n_ext (those that go on after it)."""
    fields = pairs.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    rows = materialise(pairs.mapInPandas(_masked, fields + ", template string"), "responses")
    counts = materialise(rows.groupBy("template").agg(F.count(F.lit(1)).alias("n_end")), "templates")
    endings = counts.join(extension_sums(counts, "template", "n_end", "n_ext"), "template")
    return attach(rows, materialise(endings, "endings"), "template", "n_end", rows.count())


def sample_row(q: str | None, g: str | None, a: str | None) -> tuple[str, str, str, str, str, bool, bool] | None:
    """A sampled pair as the donors take it; None without content."""
    text = content(a)
    if not text:
        return None
    q, g = q or "", g or ""
    text = LABEL.sub("", text)
    wording, lang = template(q, g, text), question_language(q)
    plain = [w for w in wording.split() if w not in ("Q", "N", "D")]
    own = (OTHER_SCRIPT.search(q) is not None or OTHER_SCRIPT.search(text) is None) and (not wordy(wording) or language(plain) == lang)
    return q, g, text, wording, lang, REFUSALS.search(text) is not None, own


def tagged(pair: tuple[str, str, str, str, str, bool, bool], donors: Donors, rng: random.Random) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, features, tags) of the training sequences made from one pair."""
    q, g = pair[:2]
    for kind, made, part in sequences(pair, donors, rng):
        text = content(made)
        if not text:
            continue
        wording = part if kind == "foreign" else template(q, g, LABEL.sub("", text))
        f, _ = clauses(q, g, text, *donors.endings(wording))
        y = np.full(len(f), {"refusal": REFUSAL, "echo": ECHO, "foreign": FOREIGN}.get(kind, ANSWER))
        if kind == "unfinished":
            y[-1] = UNFINISHED
        elif kind == "echo+answer":
            y[: min(len(f) - 1, len(clauses(q, g, part, 0, 0)[0]))] = ECHO
        yield kind, f, y


def fitted(kinds: list[str], xs: list[np.ndarray], ys: list[np.ndarray]) -> ClauseCRF:
    """The CRF of the sequences. Some sound responses are broken off behind the gold answer: those whose end a first model
    reads as unfinished are left out of the second."""
    first = ClauseCRF().fit(xs, ys)
    keep = [i for i, k in enumerate(kinds) if k != "answer" or first.tag(xs[i])[-1] != UNFINISHED]
    return ClauseCRF().fit([xs[i] for i in keep], [ys[i] for i in keep])


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ClauseCRF:
    """The CRF of a hash sample of at most about sample_rows pairs; features are worked out by the tasks."""
    spark = rows.sparkSession
    every = max(1, -(-rows.count() // sample_rows))
    drawn = rows.where(F.pmod(F.xxhash64("question_id", "row_name"), F.lit(every)) == 0).select(*COLUMNS)
    held = [x for r in drawn.orderBy(*COLUMNS).limit(2 * sample_rows).collect() if (x := sample_row(*r))]
    if not held:
        return ClauseCRF()
    shared = spark.sparkContext.broadcast((held, Donors(held)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, donors = shared.value
        for b in batches:
            out = [(k, x.astype(np.uint8).tobytes(), y.astype(np.uint8).tobytes()) for i in b["id"] for k, x, y in tagged(pairs[i], donors, random.Random(int(i)))]
            yield pd.DataFrame(out, columns=["kind", "x", "y"])

    made = spark.range(len(held)).repartition(max(1, len(held) // 500)).mapInPandas(run, "kind string, x binary, y binary")
    made = made.groupBy("kind", "x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "x", "y").collect()
    kinds, xs, ys = [], [], []
    for r in made:
        x, y = np.frombuffer(r["x"], np.uint8).reshape(-1, len(FEATURES)).astype(float), np.frombuffer(r["y"], np.uint8).astype(np.int64)
        for at in range(0, len(x), RUN):
            kinds += [r["kind"]] * r["n"]
            xs += [x[at : at + RUN]] * r["n"]
            ys += [y[at : at + RUN]] * r["n"]
    return fitted(kinds, xs, ys)


def broken_pairs(ablation: DataFrame) -> DataFrame:
    """question_id, row_name, defect_type: one row per defective pair, with at most one defect.

    Pairs are keyed by (question_id, row_name); repeated rows count once (of differing ones the greatest response holds),
    null keys form keys of their own. A null or blank response is empty; a null question or gold answer counts as an
    empty text. An empty table gives no rows.
    """
    spark = ablation.sparkSession
    pairs = ablation.groupBy("question_id", "row_name").agg(F.max(F.struct("predicted_answer", "question", "gold_answer")).alias("x"))
    rows = materialise(with_endings(pairs.select("question_id", "row_name", "x.question", "x.gold_answer", "x.predicted_answer")), "pairs")
    crf = spark.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [
                defect(q or "", g or "", a, n, m, crf.value)
                for q, g, a, n, m in zip(b["question"], b["gold_answer"], b["predicted_answer"], b["n_end"], b["n_ext"])
            ]
            yield pd.DataFrame({"question_id": b["question_id"], "row_name": b["row_name"], "defect_type": found})

    return rows.mapInPandas(run, "question_id string, row_name string, defect_type string").where(F.col("defect_type").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(load(spark, sf_dir, "agentic_ablation"))


QUERIES = {"p1_found": p1_found}
ORACLE: dict[str, str] = {}
