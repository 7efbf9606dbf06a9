import pytest

from docloom.plans import catalog
from tests.compare import spark_rows, sql_rows
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, DATA)) == sql_rows(catalog.ORACLES[name], DATA)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_full_documentation_holds_whole_pages(spark):
    from docloom.functions import html
    from docloom.plans import pages_q
    from docloom.sources import pages as src

    files = {r["kb_id"]: r["content"] for r in catalog.QUERIES["llms_full_txt_whole"](spark, DATA).collect()}
    text = {r["page_id"]: r["markdown"] for r in html.convert(src.read(spark, DATA)).collect()}
    pages = pages_q.table(spark, DATA).collect()
    assert len(pages) > 0 and all(f"## {p['path'] if p['title'] is None else p['title']}\n" in files[p["kb_id"]] and text[p["page_id"]].strip() in files[p["kb_id"]] for p in pages)


def test_listed_pages_that_share_a_path_keep_one_order(spark, tmp_path):
    rows = [(k, f"https://e.org/a#{k % 40:02}", f"<h1>{k // 40}</h1>") for k in range(80)]
    got = []
    for name, dealt in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(dealt, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got.append([(r["path"], r["url"], r["title"]) for r in catalog.QUERIES["list_pages"](spark, f"{tmp_path}/{name}").collect()])
    assert got[0] == got[1] == sorted(("a", u, x[4:-5]) for _, u, x in rows)
