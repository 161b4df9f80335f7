"""The model step: what the model is given, what becomes of its vectors, and how often it is loaded."""

import tempfile
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from statuta.sources import models


def test_a_model_is_loaded_once_a_worker(spark):
    seen = tempfile.mkdtemp(dir="/tmp", prefix="spark-")

    def make():
        import os
        import uuid

        open(f"{seen}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(texts):
            assert 0 < len(texts) <= 4
            return np.array([[len(t), t.count("e"), t.startswith("passage: ") * 1.0] for t in texts])

        return encode

    rows = spark.range(0, 90, 1, 12).select("id", F.when(F.col("id") % 9 != 0, F.concat(F.lit("é" * 3), F.col("id").cast("string"))).alias("text"))
    got = {r.id: r.embedding for r in models.embed_column(make, "e5-small", batch=4)(rows).collect()}
    assert len(got) == 90
    for k, v in got.items():
        text = "passage: " + (unicodedata.normalize("NFC", "é" * 3 + str(k)) if k % 9 else "")
        want = np.array([len(text), text.count("e"), 1.0])
        assert np.allclose(v, want / np.linalg.norm(want))
    import os

    by_worker = [name.split("-")[0] for name in os.listdir(seen)]
    assert len(by_worker) == len(set(by_worker))


def test_zero_vectors_and_no_rows(spark):
    step = models.embed_column(lambda: lambda texts: np.zeros((len(texts), 2)))
    rows = spark.createDataFrame([("a",), (None,), ("",)], "text string")
    assert [list(r.embedding) for r in step(rows).collect()] == [[0, 0]] * 3
    assert step(rows.where("text = 'none'")).collect() == []
