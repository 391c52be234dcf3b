"""Places where a model of one's own can be put in; each takes and returns tables, and each default needs no model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def model_stage(rows: DataFrame, stage: Stage, added: str) -> DataFrame:
    """rows through a model that adds the columns ``added`` (DDL), Arrow batch by batch."""
    fields = rows.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    return rows.mapInPandas(stage, f"{fields}, {added}")


def halving(stage: Stage, least: int = 1) -> Stage:
    """A stage that tries a batch again in halves when it runs out of memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                yield from list(stage(iter([b])))
            except MemoryError:
                if len(b) <= least:
                    raise
                yield from each(b.iloc[: len(b) // 2])
                yield from each(b.iloc[len(b) // 2 :])

        for b in batches:
            yield from each(b)

    return run


def captured(stage: Stage) -> Stage:
    """A stage whose rows that fail come out with the error in ``error`` instead of ending the batch; a batch that fails is
    tried row by row. The stage's own columns are null for a failed row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                yield from [part.assign(error=None) for part in stage(iter([b]))]
            except Exception as e:  # noqa: BLE001 - any error of a model is the row's
                if len(b) <= 1:
                    yield b.assign(error=f"{type(e).__name__}: {e}")
                else:
                    for at in range(len(b)):
                        yield from each(b.iloc[at : at + 1])

        for b in batches:
            yield from each(b)

    return run


def profiled(build: Callable[[], DataFrame], budget_seconds: float = 60.0) -> dict:
    """Seconds, rows, exchanges of the plan and whether the budget held, of one query run in full."""
    began = time.perf_counter()
    df = build()
    rows = df.count()
    seconds = time.perf_counter() - began
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {"seconds": round(seconds, 3), "rows": rows, "exchanges": plan.count("Exchange "), "within_budget": seconds <= budget_seconds}


def resolved_references(texts: DataFrame, text_col: str, stage: Stage | None = None) -> DataFrame:
    """Texts with pronouns put back to names by a model; without one the texts stay as they are."""
    if stage is None:
        return texts.withColumn("resolved", F.col(text_col))
    return model_stage(texts, stage, "resolved string")


def reranked(ranked: DataFrame, score: Stage | None = None, top: int = 10) -> DataFrame:
    """the first ``top`` rows of each list by a pair model's score, the others behind them in their order."""
    rows = ranked.withColumn("model_score", F.lit(None).cast("double")) if score is None else model_stage(ranked, score, "model_score double")
    head = F.col("rank") <= top
    order = F.struct(F.when(head, 0).otherwise(1), F.when(head & F.col("model_score").isNotNull(), -F.col("model_score")).otherwise(0.0), F.col("rank"))
    from pyspark.sql.window import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(order)))
