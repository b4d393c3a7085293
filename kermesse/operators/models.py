"""Pluggable models: texts to vectors, prompts to answers, in batches inside Spark tasks.

A model is given as a factory, called once per Python worker, that returns a function over a
list of texts. The functions below only batch, check and type its results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kermesse.constants import EMBED_BATCH

ROWS_PER_TASK = 20_000  # texts embedded by one task

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Generator = Callable[[Sequence[str]], Sequence[str]]


def embed(
    text: Column, factory: Callable[[], Embedder], *, batch_size: int = EMBED_BATCH
) -> Column:
    """Vector of each text as array<float>; fails when a batch comes back with another count."""
    if batch_size <= 0:
        raise ValueError("batch size must be positive")

    def make():
        import numpy as np

        model = factory()

        def predict(texts):
            vectors = np.asarray(model([str(t) for t in texts]), dtype=np.float32)
            if len(vectors) != len(texts):
                raise RuntimeError(f"{len(texts)} texts sent, {len(vectors)} vectors received")
            return vectors

        return predict

    # The model may be remote or costly: never let the optimizer evaluate it twice.
    udf = predict_batch_udf(
        make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    ).asNondeterministic()
    return udf(text)


def generate(
    prompt: Column, factory: Callable[[], Generator], *, batch_size: int = EMBED_BATCH
) -> Column:
    """Answer to each prompt; fails when a batch comes back with another count."""
    if batch_size <= 0:
        raise ValueError("batch size must be positive")

    def make():
        import numpy as np

        model = factory()

        def predict(prompts):
            answers = [str(a) for a in model([str(p) for p in prompts])]
            if len(answers) != len(prompts):
                raise RuntimeError(f"{len(prompts)} prompts sent, {len(answers)} answers received")
            return np.array(answers, dtype=object)

        return predict

    udf = predict_batch_udf(
        make, return_type=T.StringType(), batch_size=batch_size
    ).asNondeterministic()
    return udf(prompt)


def hashed_token_embedder(dimensions: int = 64) -> Callable[[], Embedder]:
    """Offline stand-in for a real model: counts of tokens hashed (MD5) to a fixed width."""

    def factory() -> Embedder:
        from functools import lru_cache
        from hashlib import md5

        import numpy as np

        @lru_cache(maxsize=1 << 16)
        def slot(token: str) -> int:
            return int(md5(token.encode()).hexdigest()[:7], 16) % dimensions

        def model(texts):
            out = np.zeros((len(texts), dimensions), dtype=np.float32)
            for row, text in zip(out, texts):
                slots = [slot(t) for t in text.lower().split()]
                row += np.bincount(slots, minlength=dimensions) if slots else 0
            return out

        return model

    return factory


def embed_table(
    df: DataFrame,
    factory: Callable[[], Embedder],
    *,
    text: str = "chunk_text",
    keep: Sequence[str] = ("chunk_id", "uid"),
    batch_size: int = EMBED_BATCH,
    spread_by: str | None = None,
    rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The kept columns and `embedding`.

    A model costs far more than a shuffle. Where the texts may sit in few partitions or one long
    document holds many of them, `spread_by` names a near-unique column to spread them by. Their
    number follows the rows: `rows`, or a count where it is not given, over `rows_per_task`, and no
    less than the cluster's cores, so that small data is spread too.
    """
    if spread_by is not None:
        spark = df.sparkSession
        known = df.count() if rows is None else rows
        partitions = max(-(-known // rows_per_task), spark.sparkContext.defaultParallelism)
        df = df.select(*keep, text).repartition(partitions, spread_by)
    return df.select(*keep, embed(F.col(text), factory, batch_size=batch_size).alias("embedding"))
