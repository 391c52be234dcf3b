"""Problem 8: filling fixed-capacity windows with texts, by vector bin packing.

A text is sized in tokens of a public tokenizer; one longer than a window is cut into full windows and a remainder, no
other text is split. A question and answer pair beyond a window's limits is cut likewise. Items are dealt by hash into packing groups of bounded size, and each group is packed on its own:
the open window takes, again and again, the item that fits and has the largest dot product with the window's remaining
room in tokens, segments and loss-bearing tokens. The items of windows that stay underfull are dealt anew in later
rounds, where the groups' leftovers meet.

Plain texts bear loss on every token but the first, so there only tokens and segments can be short. Instruction data is
where the three limits compete: a question bears no loss and its answer does, so a window may run out of segments or of
loss-bearing tokens long before it is full.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.sources.shared import load, materialise

WINDOW = 2048
MAX_SEGMENTS = 128
MAX_LOSS = 2048
#: limits of windows of question and answer pairs: tokens, pairs, loss-bearing tokens
PAIR_LIMITS = (2048, 96, 512)
GROUP_ITEMS = 8_000
ROUNDS = 3
FULL = 0.995
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    """The tiktoken encoding of a ranks file's content, built once per Python worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def counted(rows: DataFrame, columns: dict[str, str], tokenizer: str = TOKENIZER) -> DataFrame:
    """rows with the number of tokens of each text column, under the given names; null has none.

    The ranks file (about a megabyte) is read by the driver and broadcast, so no worker needs the path.
    """
    with open(tokenizer, "rb") as f:
        ranks = rows.sparkSession.sparkContext.broadcast(f.read())
    fields = rows.drop(*columns).schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks.value)
        for batch in batches:
            sizes = {name: np.array([len(enc.encode_ordinary(t)) if t else 0 for t in batch[c]], np.int64) for c, name in columns.items()}
            yield batch.drop(columns=list(columns)).assign(**sizes)

    return rows.mapInPandas(count, ", ".join([fields, *[f"{name} long" for name in columns.values()]]))


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document with at least one token; null and empty texts have none."""
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return counted(texts, {"text": "n_tokens"}, tokenizer).where("n_tokens > 0")


def pieces(sizes: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item: doc_id, piece, token_start, n_tokens, n_loss. Only a text longer than a window has two or more.

    The first token of a segment has nothing before it to be predicted from; all others bear loss.
    """
    n = F.col("n_tokens")
    cut = sizes.select("doc_id", n, F.explode(F.sequence(F.lit(0), F.ceil(n / window).cast("int") - 1)).alias("piece"))
    start = (F.col("piece") * window).cast("long")
    cut = cut.select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(window), n - start).cast("long").alias("n_tokens"))
    return cut.withColumn("n_loss", F.greatest(F.col("n_tokens") - 1, F.lit(0)).cast("long"))


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The window number of each item; limits: tokens, segments, loss-bearing tokens of a window."""
    room = np.array(limits, float)
    kinds, kind_of = np.unique(np.stack([tokens, np.ones_like(tokens), loss], 1), axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    order = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    next_item = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = kinds / room
    if (share > 1).any():
        raise ValueError("an item is larger than a window")
    window, at, free = np.zeros(len(tokens), np.int64), 0, np.ones(3)
    remaining = len(tokens)
    while remaining:
        fits = (left > 0) & (share <= free + 1e-9).all(1)
        if not fits.any():
            at, free = at + 1, np.ones(3)
            continue
        k = int(np.argmax(np.where(fits, share @ free, -1.0)))
        window[order[next_item[k]]] = at
        next_item[k] += 1
        left[k] -= 1
        free = free - share[k]
        remaining -= 1
    return window


def pack_windows(items: DataFrame, limits: tuple[int, int, int] = (WINDOW, MAX_SEGMENTS, MAX_LOSS), group_items: int = GROUP_ITEMS, rounds: int = ROUNDS, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """items with window_id (round, group and number): every item once, no window beyond any limit.

    A group holds about group_items items by hash of their keys, and each group is a partition of its own. Windows filled
    to FULL in some limit are kept; the items of the others are dealt again, and the last round keeps all of its windows.
    No items give no rows; an item beyond a limit of its own raises ValueError.
    """
    keys = list(keys)
    schema = items.schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", window_id string, fill double"
    columns = items.columns

    def packed(tag: int):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(keys)
            w = pack(group["n_tokens"].to_numpy(), group["n_loss"].to_numpy(), limits)
            use = np.stack([np.bincount(w, group["n_tokens"]) / limits[0], np.bincount(w) / limits[1], np.bincount(w, group["n_loss"]) / limits[2]])
            fill = use.max(0)[w]
            return group[columns].assign(window_id=[f"{tag}-{key[0]}-{x}" for x in w], fill=fill)

        return run

    todo, done = items, None
    for tag in range(rounds):
        n = todo.count()
        groups = max(1, round(n / group_items))
        dealt = todo.withColumn("_g", F.pmod(F.xxhash64(*keys, F.lit(tag)), F.lit(groups)).cast("int"))
        out = materialise(dealt.repartition(groups, "_g").groupBy("_g").applyInPandas(packed(tag), schema), "packed")
        last = tag == rounds - 1 or groups == 1
        kept = (out if last else out.where(F.col("fill") >= FULL)).select(*columns, "window_id")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        todo = out.where(F.col("fill") < FULL).select(*columns)
    return done


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's pieces with their windows."""
    sizes = materialise(token_sizes(load(spark, sf_dir, "documents")), "token-sizes")
    return pack_windows(pieces(sizes))


def pair_sizes(records: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(question_id, n_prompt, n_loss): the tokens of each question and of its gold answer; only the answer's bear loss.

    Repeated questions count once (of differing ones the greatest holds). Pairs without a token are left out, as there is
    nothing to place.
    """
    pair = records.where(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.max(F.struct("question", "gold_answer")).alias("x"))
    sizes = counted(pair.select("question_id", "x.question", "x.gold_answer"), {"question": "n_prompt", "gold_answer": "n_loss"}, tokenizer)
    return sizes.where(F.col("n_prompt") + F.col("n_loss") > 0)


def instruction_items(records: DataFrame, tokenizer: str = TOKENIZER, limits: tuple[int, int, int] = PAIR_LIMITS) -> DataFrame:
    """(question_id, n_tokens, n_loss) of the pairs that a window holds whole; pair_pieces has the others too."""
    out = pair_sizes(records, tokenizer).select("question_id", (F.col("n_prompt") + F.col("n_loss")).alias("n_tokens"), "n_loss")
    return out.where((F.col("n_tokens") <= limits[0]) & (F.col("n_loss") <= limits[2]))


def pair_pieces(sizes: DataFrame, limits: tuple[int, int, int] = PAIR_LIMITS) -> DataFrame:
    """One row per item: question_id, piece, token_start, n_tokens, n_loss. Only a pair that no window can hold has two or more.

    Such a pair is cut, each piece as long as a window holds: full windows of the question, its end with the answer's
    beginning, and what is left of the answer. Every token is in one piece, and bears loss there if it is the answer's.
    """
    window, _, most = limits
    prompt, n = F.col("n_prompt"), F.col("n_prompt") + F.col("n_loss")
    full, step = F.floor(prompt / window), min(window, most)
    mixed = prompt + F.least(F.col("n_loss"), window - prompt % window, F.lit(most))
    last = full + F.ceil((n - mixed) / step) - F.when(mixed == full * window, 1).otherwise(0)
    cut = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    start = F.when(F.col("piece") <= full, F.col("piece") * window).otherwise(mixed + (F.col("piece") - full - 1) * step)
    end = F.when(F.col("piece") < full, (F.col("piece") + 1) * window).otherwise(F.least(n, mixed + (F.col("piece") - full) * step))
    return cut.select("question_id", "piece", start.cast("long").alias("token_start"), (end - start).cast("long").alias("n_tokens"), F.greatest(end - F.greatest(start, prompt), F.lit(0)).cast("long").alias("n_loss"))


def p8_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and answer pair's pieces with their windows, under the three limits of PAIR_LIMITS."""
    sizes = materialise(pair_sizes(load(spark, sf_dir, "agentic_ablation")), "pair-sizes")
    return pack_windows(pair_pieces(sizes), PAIR_LIMITS, keys=("question_id", "piece"))


QUERIES = {"p8_windows": p8_windows, "p8_instructions": p8_instructions}
ORACLE: dict[str, str] = {}
