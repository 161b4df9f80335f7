"""The pipeline stage by stage on the smallest tables."""

import re

import numpy as np
import pytest

import corpus_pipeline
from statuta.llm.common import stash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = stash(f(spark, docs, SF), name)
    return out


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def test_no_copy_is_left(stages):
    texts = [r.text for r in stages["near_duplicates"].collect()]
    assert len(texts) == len(set(texts)) > 0.7 * stages["documents"].count()


def test_no_benchmark_item_is_left(spark, stages):
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: flat(r.text) for r in stages[n].collect()} for n in ("near_duplicates", "decontamination"))
    held = {d for d, t in before.items() if any(i in t for i in items)}
    assert held and not held & after.keys()
    assert set(before) - set(after) == held


def test_no_address_is_left(stages):
    before = {r.doc_id: r.text for r in stages["decontamination"].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages["pii"].collect()}
    assert before.keys() == after.keys()
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t) for t, _ in after.values())
    assert all(len(t) == n for t, n in after.values())


def test_every_token_is_packed(stages):
    docs = {r.doc_id for r in stages["pii"].collect()}
    rows = stages["packing"].collect()
    assert {r.doc_id for r in rows} == docs
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4")
    assert all(sum(map(len, p.values())) == next(r.doc_tokens for r in rows if r.doc_id == d) for d, p in whole.items())


INTERNAL = (
    "contamination", "langid_told", "told", "key", "md5", "row", "order", "group", "kept", "n", "id", "root", "fp", "sign", "band", "base", "spans", "terms", "held",
    "neardup_key", "pii_key", "pii_spans", "rest", "doc", "entity", "term", "ids", "start", "length", "offset", "sequence_id", "a", "b", "value", "r", "node",
)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every internal name as a column, with nulls in any column, repeats, an empty and a long text."""
    long = " ".join(f"word{k % 977} of the river" for k in range(30_000))
    texts = ["the river runs under the old bridge and on", None, "", " \n", "ok " * 3, long, "mail me at some.one@mail.org or +49 30 1234567 now", "the river runs under the old bridge and on"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, None, None, None, None), (None, "a stone bridge over the slow river at night", None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in INTERNAL)
    return spark.createDataFrame([(*r, *(f"{n} of {r[0]}" if k % 2 else None for k, n in enumerate(INTERNAL))) for r in rows], columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, SF)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
        assert sum(r.start == 0 for r in rows) == odd.count()
    else:
        assert out.columns == odd.columns
        for r in rows:
            assert [r[n] for n in INTERNAL] == [f"{n} of {r.doc_id}" if k % 2 else None for k, n in enumerate(INTERNAL)]
        ids = sorted((-1 if r.doc_id is None else r.doc_id for r in rows))
        assert ids == {
            "language_id": [-1, 0, 0, 4, 5, 5, 6, 7], "near_duplicates": [-1, 0, 1, 3, 4, 5, 6], "decontamination": sorted([-1, -1, 0, 0, 1, 2, 3, 4, 5, 5, 6, 7]), "pii": sorted([-1, -1, 0, 0, 1, 2, 3, 4, 5, 5, 6, 7]),
        }[name]
    if name == "pii":
        assert {r.text for r in rows if r.doc_id == 6} == {"mail me at [EMAIL] or [PHONE] now"} and {r.text for r in rows if r.doc_id == 1} == {None}
    empty = stage(spark, odd.where("false"), SF)
    assert empty.columns == out.columns and empty.count() == 0


def test_run_leaves_only_the_results_of_the_stages(spark, tmp_path):
    import os

    from statuta.llm import common

    before = set(os.listdir(f"{common.shared_dir(spark)}/statuta/{spark.sparkContext.applicationId}"))
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = set(os.listdir(f"{common.shared_dir(spark)}/statuta/{spark.sparkContext.applicationId}")) - before
    assert sorted(x.rsplit("-", 1)[0] for x in left) == sorted(f"pipeline-{n}" for n, _ in corpus_pipeline.STAGES)
