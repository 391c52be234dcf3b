"""Problem 10: keyword-stuffed pages and link, tag or product lists, by a prose-trained class n-gram model.

A text becomes a sequence of function-word classes, word classes and punctuation marks; a content word or name that
stands again within REACH words is a class of its own, so that words that keep coming back show in the sequence. A trigram
model over these (fewer than 36 symbols, so at most 46656 counts whatever the corpus) is trained on the prose-like
stretches of all texts. Every word gets the perplexity of the classes around it, as a multiple of that of prose. Only
words where it is abnormally high or low are looked at further: those that are made of links, hashtags, repeated
keywords, tag lists or product rows count, which keeps reference lists, tables and refrains out. A page is reported when
such words make up more than SHARE of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.sources.shared import load

#: Function words of English, German, French and Spanish by class.
FUNCTION_WORDS = {
    "A": "the a an der die das den dem des ein eine einen einem einer eines le la les l un une los las una unos unas lo el",
    "P": "of in to by with for on at from as into near after before between under over during through among along until since against than about von zu mit auf im am an aus bei nach vor durch für über unter zwischen um bis seit gegen zum zur vom beim de du à au aux en par pour dans sur avec vers chez sous entre après avant depuis sans contre del al con por para sobre hacia desde hasta según tras d",
    "C": "and or but that which who whom whose when where while if because although though so nor und oder aber dass daß welche welcher wo wenn weil obwohl doch denn als wie et ou mais que qui dont où quand si car comme y o pero cuando donde porque aunque sino e u",
    "R": "he she it they we you i his her its their our your him them this these those there each all both some any er sie es wir ihr ihre sein seine seiner ihren diese dieser dieses il elle ils elles son sa ses leur leurs ce cette ces se s él ella ellos su sus este esta estos nos",
    "V": "is was were are be been being had has have did does do would could will can may must not no ist war waren wurde wurden sind hat hatte haben werden wird nicht kein keine est était fut sont avait été furent ne pas n es fue era han había ha fueron sido",
    "D": "later often rather nearby quietly indeed perhaps almost once again never always soon then now here very also only still just even too auch nur noch schon sehr dann später oft hier dort immer wieder fast bald aussi encore toujours souvent très plus tard ici là bientôt presque déjà también siempre muy más tarde aquí allí pronto casi ya todavía nunca",
}
FUNCTION_CLASS = {w: c for c, words in reversed(FUNCTION_WORDS.items()) for w in words.split()}
#: Symbols of the model: the classes above, word classes (content word, capitalised, the same two repeated, year, number,
#: code, link, hashtag, other mark-up), line end, punctuation marks of their own and one for all others.
SYMBOLS = [*"APCRVD", *"wBrbYNKUHM", "\n", *".,;:!?|()-–\"#*/", "x"]
NUMBER = {s: i for i, s in enumerate(SYMBOLS)}
N_SYMBOLS = 36
_HOST = r"[\w-]{1,63}+(?=\.)(?:\.[\w-]{1,63}+){0,6}\.(?:com|net|org|example|test|invalid|info|io|biz)\b(?:/[^\s<>\"')\]]*)?"
_TOKEN = re.compile(
    r"(?P<url>(?:https?://|www\.)[^\s<>\"')\]]+|\b" + _HOST + r")|(?P<tag><[^>]{0,300}>|\[/?url[^\]]{0,300}\])"
    r"|(?P<hash>#\w+)|(?P<word>[^\W_]+)|(?P<line>\n+)|(?P<mark>[^\w\s])"
)
_RUN = re.compile(r"[^\W_]+")

#: words on either side within which a word counts as repeated, and of which a prose-like stretch has so many function words
REACH, PROSE_WINDOW, PROSE_SHARE = 25, 12, 0.25
SMOOTH = 5.0
WINDOW, ECHO_WINDOW = 5, 7
MIN_REPEATS = 4
#: perplexity (nats a symbol) as a multiple of that of prose, beyond which a stretch is abnormal
HIGH, LOW = 1.15, 0.8
SHARE = 0.5


_PLAIN_TOKEN = re.compile(re.sub(r"\(\?P<\w+>", "(?:", _TOKEN.pattern))
_seen: dict[str, tuple[int, str, float]] = {}
MAX_SEEN = 300_000


def _token(s: str) -> tuple[int, str, float]:
    """(symbol number, lower-cased token, words it holds) of one token; kept for the next time it comes."""
    low = s.lower()
    kind, weight = _TOKEN.fullmatch(s).lastgroup, 0
    if kind == "word":
        c, weight = FUNCTION_CLASS.get(low), 1
        if c is None:
            if s.isdigit():
                c = "Y" if len(s) == 4 else "N"
            elif any(ch.isdigit() for ch in s):
                c = "K"
            else:
                c = "B" if s[0].isupper() else "w"
    elif kind == "url":
        c, weight = "U", len(_RUN.findall(s))
    elif kind == "tag":
        link = "http" in s or "href" in s or "url=" in s
        c, weight = ("U", len(_RUN.findall(s))) if link else ("M", 0)
    elif kind == "hash":
        c, weight = "H", 1
    elif kind == "line":
        c = "\n"
    else:
        c = s if s in NUMBER and not s.isalnum() else "x"
    if len(_seen) >= MAX_SEEN:
        _seen.clear()
    out = _seen[s] = (NUMBER[c], low, float(weight))
    return out


class Batch:
    """The texts of a batch as flat arrays: symbol, words held, word identity and text number of every token, and of every word."""

    def __init__(self, texts: Sequence[str]):
        found = [_PLAIN_TOKEN.findall(t) for t in texts]
        size = np.array([len(f) for f in found], np.int64)
        codes, distinct = pd.factorize(np.array([x for f in found for x in f], object))
        get = _seen.get
        rows = [get(x) or _token(x) for x in distinct]
        kind = np.array([r[0] for r in rows], np.int64)
        name = pd.factorize(np.array([r[1] for r in rows], object))[0].astype(np.int64)
        weight = np.array([r[2] for r in rows], float)
        self.n_texts = len(texts)
        self.text = np.repeat(np.arange(len(texts)), size)
        self.kind = kind[codes] if len(codes) else np.empty(0, np.int64)
        token_weight = weight[codes] if len(codes) else np.empty(0)
        self.at = np.flatnonzero(token_weight > 0)  # tokens that are words
        self.weight, self.of = token_weight[self.at], self.text[self.at]
        self.name = name[codes][self.at] if len(codes) else np.empty(0, np.int64)
        n = len(self.at)
        place = np.arange(n)
        # the same word before and behind, by a stable sort of (text, word)
        self.key = self.of * (len(distinct) + 1) + self.name
        order = np.argsort(self.key, kind="stable")
        again = np.flatnonzero(self.key[order][1:] == self.key[order][:-1])
        gap = place[order[again + 1]] - place[order[again]]
        self.before = np.zeros(n, bool)
        self.before[order[again + 1]] = gap <= REACH
        self.echo = self.before.copy()
        self.echo[order[again]] |= gap <= REACH
        for plain, repeated in ("wr", "Bb"):
            at = self.at[self.before & (self.kind[self.at] == NUMBER[plain])]
            self.kind[at] = NUMBER[repeated]
        self.word_kind = self.kind[self.at]
        first = np.searchsorted(self.of, np.arange(len(texts) + 1))
        self.first, self.end = first[:-1][self.of], first[1:][self.of]
        self.place = place

    def around(self, half: int) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last word within ``half`` words in the same text, for every word."""
        return np.maximum(self.first, self.place - half), np.minimum(self.end, self.place + half + 1)

    def share(self, values: np.ndarray, half: int = WINDOW) -> np.ndarray:
        """Mean of a value of words over the words within ``half``."""
        lo, hi = self.around(half)
        total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        return (total[hi] - total[lo]) / np.maximum(1, hi - lo)

    def trigrams(self) -> np.ndarray:
        """The trigram that ends at each token; a text begins behind two line ends."""
        edge = NUMBER["\n"]
        one, two = np.full(len(self.kind), edge), np.full(len(self.kind), edge)
        one[1:] = np.where(self.text[1:] == self.text[:-1], self.kind[:-1], edge)
        two[2:] = np.where(self.text[2:] == self.text[:-2], self.kind[:-2], edge)
        return (two * N_SYMBOLS + one) * N_SYMBOLS + self.kind

    def prose(self) -> np.ndarray:
        """Whether each token stands in a stretch with a prose-like share of function words."""
        if not len(self.at):
            return np.zeros(len(self.kind), bool)
        good = self.share(self.word_kind < 6, PROSE_WINDOW) >= PROSE_SHARE
        near = np.maximum(0, np.searchsorted(self.at, np.arange(len(self.kind)), "right") - 1)
        return good[near] & (self.of[near] == self.text)


def slices(texts: Sequence[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first place, texts) of runs of whole texts of about so many characters."""
    at, held, total = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        total += len(held[-1])
        if total >= chars:
            yield at, held
            at, held, total = i + 1, [], 0
    if held:
        yield at, held


def count_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of the prose-like stretches of a task: at most N_SYMBOLS^3 rows."""
    total = np.zeros(N_SYMBOLS**3, np.int64)
    for batch in batches:
        for _, texts in slices(batch["text"]):
            b = Batch(texts)
            total += np.bincount(b.trigrams()[b.prose()], minlength=len(total))
    at = np.flatnonzero(total)
    yield pd.DataFrame({"trigram": at, "n": total[at]})


class ClassModel:
    """Interpolated trigram model; ``prose`` is its mean nats a symbol on the training texts."""

    def __init__(self, trigrams: np.ndarray, counts: np.ndarray):
        c3 = np.zeros(N_SYMBOLS**3)
        c3[trigrams] = counts
        c3 = c3.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + N_SYMBOLS)
        p2 = (c2 + SMOOTH * p1) / (c2.sum(1, keepdims=True) + SMOOTH)
        p3 = (c3 + SMOOTH * p2[None]) / (c3.sum(2, keepdims=True) + SMOOTH)
        self.nats = -np.log(p3).ravel()
        self.prose = float((c3.ravel() * self.nats).sum() / max(1.0, c3.sum()))

    def abnormal(self, ratio: np.ndarray) -> np.ndarray:
        """Whether a perplexity, as a multiple of that of prose, is abnormally high or low."""
        return (ratio > HIGH) | (ratio < LOW)


def among(symbols: str, kinds: np.ndarray) -> np.ndarray:
    return np.array([s in symbols for s in [*SYMBOLS, *" " * (N_SYMBOLS - len(SYMBOLS))]])[kinds]


def judge(texts: Sequence[str], model: ClassModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of words in abnormal stuffed or listed stretches, class perplexity, words) of every text."""
    b = Batch(texts)
    nats = model.nats[b.trigrams()]
    n = np.bincount(b.of, b.weight, b.n_texts)
    tokens = np.bincount(b.text, minlength=b.n_texts)
    perplexity = np.where(tokens > 0, np.exp(np.bincount(b.text, nats, b.n_texts) / np.maximum(1, tokens)), 0.0)
    k = b.word_kind
    total = np.concatenate([[0.0], np.cumsum(nats)])
    lo, hi = b.around(WINDOW)
    first, last = b.at[lo], b.at[hi - 1] + 1
    odd = model.abnormal((total[last] - total[first]) / (last - first) / model.prose)
    links = (b.share(among("U", k)) >= 0.15) | (b.share(among("H", k)) >= 0.3)
    function = b.share(among("APCRVD", k))
    rows = (function <= 0.12) & (b.share(among("K", k)) >= 0.08)
    tags = (function <= 0.1) & (b.share(among("wrH", k)) >= 0.7)
    content = among("wrBbKHU", k)
    _, which, times = np.unique(b.key, return_inverse=True, return_counts=True)
    often = content & (times[which] >= MIN_REPEATS)
    keywords = (b.share(often) / np.maximum(b.share(content), 1e-9) >= 0.5) & (function <= 0.45) & (b.share(b.echo, ECHO_WINDOW) >= 0.4)
    bad = odd & (links | rows | tags | keywords)
    return np.bincount(b.of, b.weight * bad, b.n_texts) / np.maximum(1, n), perplexity, n.astype(np.int64)


def class_model(documents: DataFrame) -> ClassModel:
    """The model of the prose-like stretches of all texts; at most N_SYMBOLS^3 counts reach the driver."""
    texts = documents.select("text").where(F.col("text").isNotNull())
    counts = texts.mapInPandas(count_classes, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    return ClassModel(counts["trigram"].to_numpy(), counts["n"].to_numpy())


def page_scores(documents: DataFrame) -> DataFrame:
    """doc_id, share, perplexity, n_words for every text with a word; null, empty and blank texts have no row.

    Repeated texts under other doc_id get rows of their own; a table without texts gives none.
    """
    model = documents.sparkSession.sparkContext.broadcast(class_model(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, held in slices(batch["text"]):
                share, perplexity, n = judge(held, model.value)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(held)].to_numpy(), "share": share, "perplexity": perplexity, "n_words": n})

    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return texts.mapInPandas(run, "doc_id long, share double, perplexity double, n_words long").where("n_words > 0")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_scores(load(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("share") > SHARE).select("doc_id").distinct()


QUERIES = {"p10_scores": p10_scores, "p10_found": p10_found}
ORACLE: dict[str, str] = {}
