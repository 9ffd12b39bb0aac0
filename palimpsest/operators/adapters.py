"""Adapters for models outside of Spark: encoders of texts and annotators of queries, called in batches with retries.

A model is a plain function from a list of texts to a list of results. It runs in the executors, in Arrow batches; what fails for good gives a defined value, so
that a job never ends half-way, and a resumed run (``streaming.resume``) takes up what is missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]
Answerer = Callable[[list[str]], Sequence[str | None]]


def with_retries(call: Callable, texts: list[str], retries: int, pause: float) -> list | None:
    """The results for the texts, or None when every attempt raised or gave another number of results. Waits double from ``pause`` seconds."""
    for attempt in range(retries):
        try:
            out = list(call(texts))
            if len(out) == len(texts):
                return out
        except Exception:  # a model may raise anything; the attempt counts as failed
            pass
        if attempt + 1 < retries:
            time.sleep(pause * 2**attempt)
    return None


def _batched(call: Callable, column: str, out: str, kind: pa.DataType, batch: int, retries: int, pause: float, usable: Callable[[str | None], bool], missing: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column).to_pylist()
            todo = [k for k, t in enumerate(texts) if usable(t)]
            result = [missing] * len(texts)
            for a in range(0, len(todo), batch):
                part = todo[a : a + batch]
                got = with_retries(call, [texts[k] for k in part], retries, pause)
                for k, v in zip(part, got or [missing] * len(part)):
                    result[k] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(result, kind)], [*b.schema.names, out])

    return run


def encode(df: DataFrame, text: str, model: Encoder, size: int, out: str = "embedding", batch: int = 25, retries: int = 5, pause: float = 1.0, longest: int = 100_000) -> DataFrame:
    """Adds a vector of ``size`` numbers for each text.

    Null, blank and over-long texts (more than ``longest`` characters) and batches that fail ``retries`` times have a vector of zeros; such texts are not sent.
    """
    zeros = [0.0] * size
    usable = lambda t: bool(t and t.strip()) and len(t) <= longest
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{out}` array<double>"
    return df.mapInArrow(_batched(model, text, out, pa.list_(pa.float64()), batch, retries, pause, usable, zeros), schema)


def annotate(df: DataFrame, query: str, model: Answerer, out: str = "answer", prompt: str = "{query}", batch: int = 25, retries: int = 5, pause: float = 1.0) -> DataFrame:
    """Adds the model's answer to a prompt for each query, as text. Null and blank queries and batches that fail have null, which counts as not done."""
    asked = df.withColumn("_prompt", F.when(F.col(query).isNotNull() & (F.trim(query) != ""), F.replace(F.lit(prompt), F.lit("{query}"), F.col(query))))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in asked.schema.fields)}, `{out}` string"
    return asked.mapInArrow(_batched(model, "_prompt", out, pa.string(), batch, retries, pause, bool, None), schema).drop("_prompt")


def time_scores(df: DataFrame, query: str, model: Answerer, prompt: str, **options: int) -> DataFrame:
    """query, score: each distinct query once, with a score in [0, 1] read from the model's answer; answers that are no such number give 0.0, failures null."""
    from palimpsest.functions.text import safe_unit

    once = df.select(query).filter(F.col(query).isNotNull()).distinct()
    x = annotate(once, query, model, "_a", prompt, **options)
    return x.select(query, F.when(F.col("_a").isNotNull(), safe_unit(F.trim("_a"))).alias("score"))
