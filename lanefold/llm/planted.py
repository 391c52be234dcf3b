"""Training sequences for the clause CRF of problem 1: responses whose tags are known by the way they are made."""

from __future__ import annotations

import random
from bisect import bisect_left

import regex

_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_YES_NO = regex.compile(r"(?:yes|no|ja|nein|oui|non|sí|si)(?= [,.;:!]|$)")
LAST = "\U0010ffff"
#: Letters of two other scripts that stand in for the Latin ones, in the order of the alphabet.
OTHER_LETTERS = ("абцдефгхийклмнопкрстуввхыз", "这是一个在不有我他大来了地上们国和到说时要就出会")
#: Words that link a further clause, by language.
LINKS = {
    "en": "and but or who which that where when while because also".split(), "de": "und aber oder der die das wo weil obwohl".split(),
    "fr": "et mais ou qui que où".split(), "es": "y pero o que quien donde".split(),
}
NAME_LINKS = "of the for and de du des la le les del der die das und y et".split()
LABELS = ("", "", "", "Question: ", "Q: ")
#: a wording counts as one of declining when it stands for at least so many different gold answers
LEAST_GOLDS = 3
RATE, CUT_RATE = 0.2, 0.4


class Donors:
    """What a bounded sample of pairs tells about responses: sound ones by language, declining ones, and all wordings."""

    def __init__(self, rows: list[tuple[str, str, str, str, str, bool, bool]]):
        """rows: (question, gold, response, masked wording, question's language, whether it has a word of declining,
        whether it is in the question's language and script or too short to tell)."""
        self.wordings = sorted(r[3] for r in rows)
        golds: dict[str, set[str]] = {}
        sound = set()
        for q, g, text, wording, lang, cue, own in rows:
            if own and not cue and self.holds(text, g):
                sound.add((lang, wording))
            golds.setdefault(wording, set()).add(g)
        self.sound_wordings = sound
        self.declining = {w for w, x in golds.items() if len(x) >= LEAST_GOLDS and not {"N", "D"} & set(w.split()) and not _YES_NO.match(w)}
        #: (question, gold, response, wording) by language
        self.sound: dict[str, list[tuple[str, str, str, str]]] = {}
        self.sentences: dict[str, list[tuple[str, str, str, str]]] = {}
        self.refusals: dict[str, list[tuple[str, str, str, str]]] = {}
        for q, g, text, wording, lang, cue, own in rows:
            if (lang, wording) in sound:
                self.sound.setdefault(lang, []).append((q, g, text, wording))
                if wordy(wording):
                    self.sentences.setdefault(lang, []).append((q, g, text, wording))
            elif cue and own and wording in self.declining:
                self.refusals.setdefault(lang, []).append((q, g, text, wording))

    @staticmethod
    def holds(text: str, gold: str) -> bool:
        """Whether the response has the gold answer as whole words."""
        a, g = (" ".join(_WORD.findall(x.lower())) for x in (text, gold))
        return bool(g) and f" {g} " in f" {a} "

    def endings(self, wording: str) -> tuple[int, int]:
        """(responses of just this wording, responses that go on after it) in the sample, itself not counted."""
        lo, hi = bisect_left(self.wordings, wording), bisect_left(self.wordings, wording + LAST)
        mid = bisect_left(self.wordings, wording + "\0")
        return mid - lo, hi - mid


def broken_off(text: str, gold: str, rng: random.Random) -> str | None:
    """The response up to a random letter inside a word, name or clause; None where it may be complete there."""
    at = rng.randrange(max(1, len(text) // 5), len(text)) if len(text) > 1 else 0
    head, tail = text[:at].rstrip(), text[at:]
    if not _WORD.search(head) or not _WORD.search(tail) or head[-1:] in ".!?;:,…。" or tail.lstrip()[:1] in ".!?,;:…。)\"'":
        return None
    last, known = _WORD.findall(head)[-1].lower(), _WORD.findall(gold.lower())
    if tail[:1].isspace() and (text.islower() or last in known[-1:] or _YES_NO.fullmatch(last) or all(not w[0].islower() or w in NAME_LINKS for w in _WORD.findall(head))):
        return None
    return head + rng.choice(["", "", "", "", "...", " ...", "…", ","])


def hung_on(text: str, other: str, lang: str, rng: random.Random) -> str:
    """The response with a further clause begun behind it: a linking word, bracket or quotation mark and up to three words."""
    words = _WORD.findall(other)
    at = rng.randrange(len(words))
    begun = " ".join(words[at : at + rng.randrange(3)])
    opened = rng.choice([", " + w for w in LINKS.get(lang, LINKS["en"])] + [" (", " (", ', "', ", "])
    return text.rstrip(" .") + opened + ("" if opened.endswith(("(", '"')) else " ") + begun


def retyped(question: str, rng: random.Random) -> str:
    """The question with slips, a label, other case or no mark, or twice."""
    out = question
    case = rng.random()
    if case < 0.5:
        out = out.lower() if case < 0.4 else out.upper()
    if rng.random() < 0.4:
        out = out.rstrip(" ?")
    for _ in range(rng.choice([0, 0, 1, 2])):
        words = out.split(" ")
        k = rng.randrange(len(words))
        w = words[k]
        if len(w) > 4:
            i = rng.randrange(1, len(w) - 2)
            words[k] = rng.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:]])
        out = " ".join(words)
    if rng.random() < 0.2:
        out = out + " " + out
    if rng.random() < 0.15:
        out = f'"{out}"'
    return rng.choice(LABELS) + out


def exchanged(donor: tuple[str, str, str, str], gold: str) -> str:
    """The donor's response with this pair's gold answer in place of the donor's."""
    _, g, text, _ = donor
    return regex.sub(regex.escape(g), lambda m: gold, text, flags=regex.IGNORECASE) if g else text


def respelt(text: str, names: set[str], rng: random.Random) -> str:
    """The response with its words, but for the given names and numbers, in another script."""
    letters = rng.choice(OTHER_LETTERS)
    swap = lambda m: m[0] if m[0].lower() in names or m[0][0].isdigit() else "".join(letters[ord(c) % len(letters)] for c in m[0].lower())
    return _WORD.sub(swap, text)


_OPTIONS = regex.compile(r",\s*(.+?)\s+(?:or|oder|ou|o)\s+(.+?)\s*\?*\s*$", regex.IGNORECASE)


def other_option(question: str, gold: str) -> str | None:
    """The option that a question offers beside the gold answer: a complete, wrong answer in the question's own words."""
    m = _OPTIONS.search(question)
    rest = [x for x in m.groups() if x.lower() != gold.lower()] if m else []
    return rest[0] if len(rest) == 1 else None


def wordy(wording: str) -> bool:
    """Whether a masked wording is a sentence of its language: at least two words that are no names, numbers or gold words."""
    return sum(w not in ("Q", "N", "D") and w.isalpha() for w in wording.split()) > 1


def sequences(pair: tuple[str, str, str, str, str, bool, bool], donors: Donors, rng: random.Random):
    """(kind, response, wording) made from one pair; kinds: answer, name (a short answer), unfinished, echo, echo+answer, foreign, refusal.

    ``wording`` is the masked wording whose endings count, None where it is the response's own; ``echo+answer`` has the
    question part in its place. Defects are made at RATE, so that they are
    about as rare beside the sound responses as defects are: a wrong name is no more likely to be a broken one.
    """
    q, g, text, wording, lang, cue, own = pair
    if q.strip() and rng.random() < RATE:
        yield "echo", retyped(q, rng), None
    option = other_option(q, g)
    if option:
        yield "name", option, None
    if (lang, wording) in donors.sound_wordings:
        yield "answer" if wordy(wording) else "name", text, None
        if rng.random() < CUT_RATE:
            for _ in range(3):
                cut = broken_off(text, g, rng)
                if cut:
                    yield "unfinished", cut, None
                    break
        if rng.random() < RATE / 2:
            yield "unfinished", hung_on(text, rng.choice(donors.sound[lang])[2], lang, rng), None
        if q.strip() and rng.random() < RATE:
            part = retyped(q, rng).strip('"').rstrip(" ?") + "?"
            yield "echo+answer", part + rng.choice(["\n", " "]) + (text if rng.random() < 0.5 or not g else g), part
        others = [x for x in sorted(donors.sentences) if x != lang]
        if others and rng.random() < RATE:
            donor = rng.choice(donors.sentences[rng.choice(others)])
            yield "foreign", exchanged(donor, g), donor[3]
        if wordy(wording) and rng.random() < RATE:
            kept = {w.lower() for w in _WORD.findall(q + " " + g) if not w[0].islower()} if rng.random() < 0.5 else set()
            yield "foreign", respelt(text, kept, rng), wording if kept else LAST
        if donors.refusals.get(lang) and rng.random() < RATE:
            yield "answer", rng.choice(donors.refusals[lang])[2].rstrip(" .") + rng.choice([", but ", ". ", "; "]) + text, None
    elif cue and own and wording in donors.declining:
        yield "refusal", text, None
        if rng.random() < RATE:
            yield "refusal", text.rstrip(" .") + ". " + text, None
    other = [x for x in sorted(donors.refusals) if x != lang]
    if other and rng.random() < RATE / 2:
        donor = rng.choice(donors.refusals[rng.choice(other)])
        yield "foreign", donor[2], donor[3]
