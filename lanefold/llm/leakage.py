"""Problem 9: evaluation texts inside corpus texts, by suffix arrays over shards of the corpus.

Texts become sequences of word numbers. A shard (up to SHARD_CHARS characters of whole texts) sorts its suffixes by their first
MIN_WORDS words; a suffix that has a word outside the evaluation vocabulary among these can match nothing and is left
out. Every distinct suffix beginning of the evaluation texts is then binary-searched in the shard's suffix array, which
gives the documents that hold it. For each document and evaluation suffix that meet, the longest verbatim match is that
with the suffix's neighbour among the document's own suffixes in full order, found by a second binary search; ranks by
12, 24, 48 ... words (prefix doubling) give both the order and the length, so occurrences are never paired up.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.operators.skew import numbered, prefix_sums
from lanefold.sources.shared import load

MIN_WORDS = 12
BLOCK_CHARS = 32_000_000
#: characters of whole texts that make a shard, or one longer text
SHARD_CHARS = 4_000_000
_MARKS, _WORD = regex.compile(r"\p{Mn}+"), regex.compile(r"[\p{L}\p{Nd}]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, without case and accents."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", _MARKS.sub("", unicodedata.normalize("NFD", text)).casefold())
        return _WORD.findall(_MARKS.sub("", text))
    return _WORD.findall(text.lower())


def _keys(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n word numbers from each position, as byte strings whose order is that of the numbers."""
    return np.ascontiguousarray(ids[at[:, None] + np.arange(n)].astype(">u4")).view(f"S{4 * n}").ravel()


class EvalIndex:
    """Vocabulary, words and distinct suffix beginnings of one block of evaluation texts."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocabulary = n, {}
        rows = [(i, w) for i, t in items if len(w := words(t)) >= n]
        rows = [(i, [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]) for i, w in rows]
        self.ids = np.array([x for _, w in rows for x in [*w, 0]], np.int64)
        self.item = np.array([i for i, w in rows for _ in range(len(w) + 1)], np.int64)
        at = np.flatnonzero(run_length(self.ids) >= n)
        keys = _keys(self.ids, at, n)
        order = np.argsort(keys, kind="stable")
        self.at = at[order]  # suffixes in the order of their first n words
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.times = np.diff(np.append(self.first, len(at)))

    def search(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, ...]:
        """(text number, item, words matched, first word): the longest match of every item in every text, of n words or more."""
        none = (np.empty(0, np.int64),) * 4
        get = self.vocabulary.get
        seqs = [[get(w, 0) for w in t] for t in texts]
        ids = np.array([x for t in seqs for x in [*t, 0]], np.int64)
        size = np.array([len(t) + 1 for t in seqs], np.int64)
        owner = np.repeat(np.arange(len(seqs)), size)
        at = np.flatnonzero(run_length(ids) >= self.n)
        if not len(at) or not len(self.at):
            return none
        keys = _keys(ids, at, self.n)
        suffixes = np.argsort(keys, kind="stable")  # the shard's suffix array, to n words; texts in order within equal ones
        keys, at = keys[suffixes], at[suffixes]
        lo, hi = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.keys, "right")
        met = np.flatnonzero(hi > lo)
        if not len(met):
            return none
        held = _spans(lo[met], hi[met])  # the places of matched suffixes; the others need no order
        key = np.repeat(met, (hi - lo)[met])
        run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[at[held]][1:] != owner[at[held]][:-1])])  # one per key and text
        end = np.append(run[1:], len(held))
        used = _spans(self.first[met], (self.first + self.times)[met])
        ranks, docs_in, items_in = joint_ranks(ids, at[held], self.ids, self.at[used], self.n)
        docs_in, order = _within(docs_in, np.repeat(np.arange(len(run)), end - run), ranks[-1])
        place = at[held][order]
        # every run meets every evaluation suffix that begins with its key
        many = self.times[key[run]]
        r = np.repeat(np.arange(len(run)), many)
        start = np.cumsum(self.times[met]) - self.times[met]
        q = _spans(start[np.searchsorted(met, key[run])], start[np.searchsorted(met, key[run])] + many)
        low, high = run[r], end[r]
        aim = ranks[-1][items_in[q]]
        while (open_ := low < high).any():  # binary search of the suffix among its text's own ones
            mid = (low + high) // 2
            less = ranks[-1][docs_in[np.minimum(mid, len(docs_in) - 1)]] < aim
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        longest = np.zeros(len(r), np.int64)
        for near in (low - 1, low):
            ok = np.flatnonzero((near >= run[r]) & (near < end[r]))
            longest[ok] = np.maximum(longest[ok], common(ranks, docs_in[near[ok]], items_in[q[ok]], self.n))
        text, item = owner[place[run[r]]], self.item[self.at[used][q]]
        # per text and item the longest matches, one for each wording, with their earliest place in the text
        order = np.lexsort((aim, -longest, item, text))
        t, i = text[order], item[order]
        pair = np.cumsum(np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])]) - 1
        top = longest[order] == longest[order][np.searchsorted(pair, pair)]
        order, pair = order[top], pair[top]
        same = common(ranks, items_in[q[order[1:]]], items_in[q[order[:-1]]], self.n) >= longest[order[1:]]
        fresh = np.r_[True, ~same | (pair[1:] != pair[:-1])]
        order, pair = order[fresh], pair[fresh]
        begin = _edge(ranks, docs_in, items_in[q[order]], longest[order], run[r[order]], low[order], self.n, left=True)
        stop = _edge(ranks, docs_in, items_in[q[order]], longest[order], low[order], end[r[order]], self.n, left=False)
        where = np.full(pair[-1] + 1, len(ids))
        np.minimum.at(where, np.repeat(pair, stop - begin), place[_spans(begin, stop)])
        one = order[np.r_[True, pair[1:] != pair[:-1]]]
        first = np.cumsum(size) - size
        return text[one], item[one], longest[one], where - first[text[one]]


def _edge(ranks: list[np.ndarray], docs_in: np.ndarray, q: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, left: bool) -> np.ndarray:
    """Where the suffixes from low to high begin (left) or cease to share ``length`` words with q, by binary search."""
    while (open_ := low < high).any():
        mid = (low + high) // 2
        shares = common(ranks, docs_in[np.minimum(mid, len(docs_in) - 1)], q, n) >= length
        down = shares if left else ~shares
        low, high = np.where(open_ & ~down, mid + 1, low), np.where(open_ & down, mid, high)
    return low


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from lo to hi of every pair, one behind the other."""
    n = hi - lo
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _within(values: np.ndarray, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values ordered by rank inside each group (groups come in order), and that order."""
    order = np.lexsort((rank[values], group))
    return values[order], order


def joint_ranks(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks of the suffixes of two word sequences by n, 2n, 4n ... words in one order, and the places of at_a and at_b in it.

    Only runs of words that hold one of the places are ordered. Rank 0 means fewer words than asked for; the last level is
    the full order, where a shorter suffix stands before those it begins.
    """
    ids, places = [], []
    base = 0
    for s, at in ((a, at_a), (b, at_b)):
        zeros = np.flatnonzero(s == 0)
        of = np.searchsorted(zeros, np.arange(len(s)))
        keep = np.isin(of, np.unique(of[at])) if len(at) else np.zeros(len(s), bool)
        new = np.cumsum(keep) - 1 + base
        ids.append(s[keep])
        places.append(new[at])
        base += int(keep.sum())
    x = np.concatenate([*ids, [0]])
    reach = run_length(x)
    rank = np.unique(x, return_inverse=True)[1]
    width, levels = 1, []
    nothing = len(x) - 1
    while True:
        if width == 1:
            k = np.arange(len(x))[:, None] + np.arange(n)
            rows = np.where(np.arange(n) < reach[:, None], rank[np.minimum(k, nothing)], 0)
            rank = np.unique(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * n}").ravel(), return_inverse=True)[1]
            width = n
        else:
            after = np.where(reach > width, rank[np.minimum(np.arange(len(x)) + width, nothing)] + 1, 0)
            rank = np.unique(rank.astype(np.int64) * (len(x) + 2) + after, return_inverse=True)[1]
            width *= 2
        levels.append(np.where(reach >= width, rank + 1, 0))
        if width >= reach.max(initial=0):
            break
    return [x, *levels, rank], *places


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Words that the suffixes at a and b have in common; ranks: the words, the levels of n, 2n ... words, the full order."""
    out = np.zeros(len(a), np.int64)
    x, last = ranks[0], len(ranks[0]) - 1
    for level in range(len(ranks) - 2, 0, -1):
        p, q = ranks[level][np.minimum(a + out, last)], ranks[level][np.minimum(b + out, last)]
        out += np.where((p == q) & (p > 0), n << (level - 1), 0)
    open_ = np.arange(len(a))
    while len(open_):
        p, q = x[np.minimum(a[open_] + out[open_], last)], x[np.minimum(b[open_] + out[open_], last)]
        open_ = open_[(p == q) & (p > 0)]
        out[open_] += 1
    return out


def run_length(ids: np.ndarray) -> np.ndarray:
    """Number of nonzero entries from each position to the next zero; the last entry is zero."""
    zeros = np.flatnonzero(ids == 0)
    return (zeros[np.searchsorted(zeros, np.arange(len(ids)))] - np.arange(len(ids))) if len(ids) else ids


def item_blocks(items: DataFrame, min_words: int) -> DataFrame:
    """(block, index): the evaluation texts in blocks of at most BLOCK_CHARS characters, or one longer text, each as a pickled index.

    Blocks are cut by exact running sums, and every block's index is built by a task.
    """
    held = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    placed = numbered(held.withColumn("one", F.lit(1)), ["one"], {"_i": F.col("item_id"), "_t": F.xxhash64("text")})
    summed = prefix_sums(placed, ["one"], F.length("text"), "upto")
    blocks = summed.select(F.floor((F.col("upto") - 1) / BLOCK_CHARS).alias("block"), "item_id", "text")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item_id", "text"])
        index = EvalIndex(list(zip(group["item_id"].tolist(), group["text"].tolist())), min_words)
        return pd.DataFrame({"block": group["block"].iloc[:1], "index": [pickle.dumps(index)]})

    return blocks.groupBy("block").applyInPandas(build, "block long, index binary")


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, n_words, first_word: the longest verbatim match of every item in every document.

    A match has at least min_words consecutive words of the item; first_word counts the document's words from 0, at the
    earliest longest match. Null, empty and shorter texts match nothing; repeated items count once. The documents are read
    and cut into words once; each batch is searched for one block of items after the other, and only one block's index is
    held by a task at a time.
    """
    spark = documents.sparkSession
    blocks = [spark.sparkContext.broadcast(bytes(r["index"])) for r in item_blocks(items, min_words).orderBy("block").toLocalIterator()]
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = pickle.loads(blocks[0].value) if len(blocks) == 1 else None
        for batch in batches:
            shard = batch["text"].str.len().cumsum() // SHARD_CHARS
            for _, part in batch.groupby(shard.to_numpy()):
                ids = part["doc_id"].to_numpy()
                if only:
                    doc, item, n, at = only.search(words(t) for t in part["text"])
                    yield pd.DataFrame({"doc_id": ids[doc], "item_id": item, "n_words": n, "first_word": at})
                    continue
                texts = [words(t) for t in part["text"]]
                for block in blocks:
                    doc, item, n, at = pickle.loads(block.value).search(texts)
                    yield pd.DataFrame({"doc_id": ids[doc], "item_id": item, "n_words": n, "first_word": at})
                    block.__dict__.pop("_value", None)  # read from the task's local copy again when its turn comes

    found = docs.mapInPandas(run, "doc_id long, item_id long, n_words long, first_word long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("first_word")).alias("m"))).alias("x"))
    return best.select("doc_id", "item_id", "x.n_words", (-F.col("x.m")).alias("first_word"))


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which no item was found."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_matches(spark, sf_dir).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that stay when all affected ones are removed."""
    return without_leaks(load(spark, sf_dir, "documents").select("doc_id"), p9_found(spark, sf_dir))


QUERIES = {"p9_matches": p9_matches, "p9_found": p9_found, "p9_clean": p9_clean}

_GRAMS = """
    WITH w AS (
        SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{Nd}]+') AS w FROM documents
        UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{Nd}]+') FROM eval_items
    ), g AS (
        SELECT side, id, array_to_string(w[i:i + 11], ' ') AS gram
        FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)
    ), f AS (
        SELECT DISTINCT d.id AS doc_id, i.id AS item_id
        FROM (SELECT id, gram FROM g WHERE side = 'd') d JOIN (SELECT id, gram FROM g WHERE side = 'i') i USING (gram)
    )"""
ORACLE = {
    "p9_matches": _GRAMS.rsplit(", f AS (", 1)[0].replace("SELECT side, id, array_to_string", "SELECT side, id, i, array_to_string") + """, m AS (SELECT d.id AS doc_id, k.id AS item_id, d.i AS a, d.i - k.i AS diagonal FROM (SELECT * FROM g WHERE side = 'd') d JOIN (SELECT * FROM g WHERE side = 'i') k USING (gram)),
        r AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY a) AS island FROM (SELECT DISTINCT * FROM m)), l AS (SELECT doc_id, item_id, count(*) + 11 AS n_words, min(a) - 1 AS first_word FROM r GROUP BY doc_id, item_id, diagonal, island)
        SELECT doc_id, item_id, n_words, first_word FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, first_word) = 1""",
    "p9_found": _GRAMS + " SELECT doc_id, item_id FROM f",
    "p9_clean": _GRAMS + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)",
}
