"""Plug points for models: embedding columns and text generation, run in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from statuta.functions.text import hashing_vectors, nfc, task_prompt


def embed_column(make: Callable[[], Callable[[list[str]], np.ndarray]], model: str = "", task: str = "passage", batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A step that adds `embedding` to rows with `text`. make loads the model, once a Python worker, however many tasks that runs; texts come
    in batches, in form C with the model's prefix, a null one empty, and vectors get unit length (all zero stays)."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        encode = make()

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(encode(list(texts)), float)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(size > 0, size, 1)

        return predict

    udf = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)
    return lambda rows: rows.withColumn("embedding", udf(task_prompt(model, nfc(F.coalesce("text", F.lit(""))), task)))


#: The embedder that needs no model.
hashing = embed_column(lambda: hashing_vectors)
