"""The pipeline's stages one after another, each held against a plain rule on its own input."""

from collections import Counter

import corpus_pipeline
from docloom.llm import pieces
from tests.conftest import DATA
from tests.llm.test_operators import plain_groups, plain_spans


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "near_dedup", "personal_data", "mixing", "pieces"]

    a = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = steps["language_id"](spark, docs, DATA).cache()
    assert out.columns == columns
    b = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(b[i] == a[i] for i in b) and all(not any(c.isalpha() for c in a[i]) for i in set(a) - set(b))

    docs, out = out, steps["near_dedup"](spark, out, DATA).cache()
    assert out.columns == columns
    groups = plain_groups(list(b.items()))
    c = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(c) == {i for i, (_, g) in groups.items() if i == g}

    docs, out = out, steps["personal_data"](spark, out, DATA).cache()
    assert out.columns == columns
    d = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(d) == set(c) and all((d[i] == c[i]) == (not plain_spans(c[i])) for i in c) and not any(plain_spans(x) for x in d.values())

    docs, out = out, steps["mixing"](spark, out, DATA).cache()
    assert out.columns == columns
    times = Counter(r["doc_id"] for r in out.collect())
    assert set(times) == set(d) and max(times.values()) <= 2

    last = steps["pieces"](spark, out, DATA)
    v = pieces.vocabulary(pieces.default_model())
    rows = last.collect()
    assert len(rows) == sum(times.values()) and last.columns[: len(columns)] == columns
    assert all(r["round_trip"] and v.decode(r["ids"]) == r["text"] for r in rows)
    assert corpus_pipeline.run(spark, DATA).count() == len(rows)


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, DATA)
    assert docs.count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        f(spark, docs, DATA).collect()
