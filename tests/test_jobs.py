"""The jobs over growing input, on copies, with reruns, failures and odd rows."""

import json
import logging
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.plans import jobs_q
from jobs import common, document_index, page_sync
from tests.compare import spark_rows, sql_rows
from tests.conftest import DATA


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rows_of(df):
    return sorted((r["kb_id"], r["path"], r["title"], r["version"], r["status"], r["batch"]) for r in df.collect())


@pytest.mark.parametrize("name", ["job1_page_sync", "job2_document_index"])
def test_queries_equal_sql(spark, name):
    from docloom.plans.registry import ORACLES

    assert spark_rows(getattr(jobs_q, name)(spark, DATA)) == sql_rows(ORACLES[name], DATA)


def test_pages_over_growing_input(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="jobs.page_sync")
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    pages(spark, [(1, "https://e.org/a", "<h1>A</h1><a href=/b>b</a><a href=/b>b</a>"), (2, "https://e.org/b", "<h1>B</h1>")]).write.parquet(src)
    first = rows_of(page_sync.run(spark, src, out, state))
    assert first == [("e.org", "a", "A", 1, "new", 0), ("e.org", "b", "B", 1, "new", 0)]
    assert rows_of(page_sync.run(spark, src, out, state)) == first  # nothing new
    pages(spark, [(1, "https://e.org/a", "<h1>A</h1><a href=/b>b</a><a href=/b>b</a>"), (2, "https://e.org/b", "<h1>B two</h1>"), (3, "https://f.org/", "<h1>F</h1>")]).write.mode("append").parquet(src)
    second = rows_of(page_sync.run(spark, src, out, state))
    assert second == sorted([*first, ("e.org", "b", "B two", 2, "changed", 1), ("f.org", "index", "F", 1, "new", 1)])
    assert rows_of(page_sync.run(spark, src, out, state)) == second
    now = {(r["kb_id"], r["path"]): (r["title"], r["links"]) for r in page_sync.current(spark, out).collect()}
    assert now == {("e.org", "a"): ("A", ["https://e.org/b"]), ("e.org", "b"): ("B two", []), ("f.org", "index"): ("F", [])}
    assert any("batch 1: read" in m and "'changed': 1" in m for m in caplog.messages)
    parts = {x.name for x in (tmp_path / "out").iterdir() if x.is_dir()}
    assert parts == {"batch=0", "batch=1"}


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    pages(spark, [(1, "https://e.org/a", "<h1>A</h1>")]).write.parquet(src)
    want = rows_of(page_sync.run(spark, src, out, state))
    page_sync.take(spark, spark.read.parquet(src), 0, out)  # as after a failure between the write and the checkpoint
    assert rows_of(page_sync.versions(spark, out)) == want
    seen = []
    real = page_sync.take

    def fails(s, df, k, target):
        real(s, df, k, target)
        if not seen:
            seen.append(k)
            raise RuntimeError("lost after the write")

    pages(spark, [(1, "https://e.org/a", "<h1>A2</h1>"), (5, "https://e.org/n", "<h1>N</h1>")]).write.mode("append").parquet(src)
    page_sync.take = fails
    try:
        with pytest.raises(Exception):
            page_sync.run(spark, src, out, state)
        got = rows_of(page_sync.run(spark, src, out, state))
    finally:
        page_sync.take = real
    assert got == sorted([*want, ("e.org", "a", "A2", 2, "changed", 1), ("e.org", "n", "N", 1, "new", 1)])


def test_odd_pages(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(None, None, None), (None, None, None), (7, "https://e.org/x", "<h1>old"), (9, "https://e.org/x?q=1", "<h1>last"), (9, "https://e.org/x?q=1", "<h1>last"), (8, "https://e.org/x", None), (3, "no url", "<h1>odd")]
    df = pages(spark, rows).withColumns({"title": F.lit("clash"), "kb_id": F.lit("clash"), "LINKS": F.lit(1)})
    df.write.parquet(src)
    got = {(r["kb_id"], r["path"]): r["title"] for r in page_sync.run(spark, src, out, state, {"files_a_batch": 1}).collect() if r["version"] == 1}
    last = {(r["kb_id"], r["path"]): r["title"] for r in page_sync.current(spark, out).collect()}
    assert ("unknown", "") in got and set(last) == set(got) and len(last) == len({(k, p) for k, p in last})
    one = page_sync.read_pages(pages(spark, rows)).collect()
    assert {(r["kb_id"], r["path"]): r["title"] for r in one}["e.org", "x"] == "last" and {(r["kb_id"], r["path"]) for r in one} == {("e.org", "x"), ("unknown", ""), ("unknown", "no url")}
    empty = str(tmp_path / "none")
    pages(spark, []).write.parquet(empty)
    assert page_sync.run(spark, empty, str(tmp_path / "o2"), str(tmp_path / "s2")).count() == 0


def test_settings_and_session_are_left_as_they_were(spark, tmp_path):
    src = str(tmp_path / "in")
    pages(spark, [(1, "https://e.org/a", "x")]).write.parquet(src)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "777")
    page_sync.run(spark, src, str(tmp_path / "o"), str(tmp_path / "s"))
    assert spark.conf.get(key) == "777" and not spark.streams.active
    spark.conf.set(key, before) if before else spark.conf.unset(key)
    assert common.settings({"a": 1, "format": "orc"}, {"a": 2}) == {"a": 2, "format": "orc"}
    for bad in ({"b": 1}, {"a": "1"}, {"a": 0}, {"format": "csvx"}):
        with pytest.raises(ValueError):
            common.settings({"a": 1, "format": "orc"}, bad)


def plain_index(rows):
    """Postings by plain counting."""
    from docloom.functions import text

    import re

    fold = str.maketrans(text.MARKED, text.PLAIN)
    docs = defaultdict(Counter)
    for i, x in rows:
        if i is not None and x:
            docs[i].update(re.findall(r"[^\W_]+", x.lower().translate(fold)))
    df = Counter(t for c in docs.values() for t in c)
    return {(t, i, n, sum(c.values()), df[t]) for i, c in docs.items() for t, n in c.items()}


def test_index_equals_plain_counting_and_reruns(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="jobs.document_index")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "The cat. the CAT's élan"), (2, "the dog"), (2, "the dog"), (3, None), (4, ""), (None, "lost"), (5, "a " * 5000 + "cat"), (6, "!!!")] + [(100 + k, f"the common word {k % 7}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"term": F.lit("clash"), "TF": F.lit(1)})
    df.repartition(3).write.parquet(src)
    for n in (1, 4):
        got = {tuple(r) for r in document_index.run(spark, src, out, {"shards": n, "buckets": 5}).select("term", "doc_id", "tf", "doc_len", "df").collect()}
        assert got == plain_index(rows)
    n, mean = document_index.totals(spark, out)
    assert n == 203 and any("postings" in m for m in caplog.messages)
    best = document_index.find(spark, out, ["Cat", "ÉLAN"], 5, n, mean).collect()
    assert [r["doc_id"] for r in best] == [1, 5] and best[0]["score"] > best[1]["score"] > 0
    plan = document_index.find(spark, out, ["cat"], 5, n, mean)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and document_index.find(spark, out, ["--"], 5, n, mean).count() == 0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert document_index.run(spark, str(tmp_path / "none"), str(tmp_path / "o2")).count() == 0


def test_index_counts_words_once_and_moves_postings_once(spark, tmp_path):
    rows = [(k, f"the word w{k} and w{k // 2} the" + (" the" * k)) for k in range(300)] + [(7, "the again"), (None, "lost")]
    docs = spark.createDataFrame(rows, document_index.SOURCE)
    docs.write.parquet(str(tmp_path / "in"))
    n = document_index.DOCUMENTS
    assert [document_index.shards(k, 16) for k in (0, n - 1, n, 3 * n, 10**9)] == [1, 1, 2, 4, 16]
    s = {"buckets": 3, "shards": 4}
    built = document_index.build(docs, s, 2 * n)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Exchange") == 2 and "Join" not in plan
    assert {tuple(r) for r in built.drop("bucket").collect()} == plain_index(rows)
    out = str(tmp_path / "out")
    document_index.run(spark, str(tmp_path / "in"), out, s)
    files = [Path(f) for f in document_index.index(spark, out).inputFiles()]
    at = [[(r["term"], r["doc_id"]) for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(at) == 3 and all(x == sorted(x) for x in at) and sum(map(len, at)) == len(plain_index(rows))


def test_command_lines(spark, tmp_path):
    src, docs = str(tmp_path / "in"), str(tmp_path / "docs")
    pages(spark, [(1, "https://e.org/a", "<h1>A</h1>")]).write.orc(src)
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.json(docs)
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"format": "orc"}))
    assert page_sync.main(["--source", src, "--target", str(tmp_path / "v"), "--checkpoint", str(tmp_path / "s"), "--config", str(config)], spark) == 0
    assert page_sync.versions(spark, str(tmp_path / "v")).count() == 1
    config.write_text(json.dumps({"format": "json", "buckets": 2}))
    assert document_index.main(["--source", docs, "--target", str(tmp_path / "i"), "--config", str(config)], spark) == 0
    assert document_index.index(spark, str(tmp_path / "i")).count() == 2
    config.write_text("{")
    assert document_index.main(["--source", docs, "--target", str(tmp_path / "i"), "--config", str(config)], spark) == 2
    config.write_text(json.dumps({"nonsense": 1}))
    assert document_index.main(["--source", docs, "--target", str(tmp_path / "i"), "--config", str(config)], spark) == 2


def test_jobs_know_nothing_of_the_training_data_operators():
    from pathlib import Path

    for f in Path(page_sync.__file__).parent.glob("*.py"):
        x = f.read_text()
        assert "llm" not in x and "corpus_pipeline" not in x
