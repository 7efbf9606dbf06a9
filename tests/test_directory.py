"""Directories of knowledge bases as tables, against what the driver's readers give for each."""

import json

from docloom.plans import ingest
from docloom.sources import directory, store as st
from tests.test_operators import pages, two_sites


def test_all_directories_at_once(spark, tmp_path):
    s, root = st.Store(spark, str(tmp_path / "store")), str(tmp_path / "kbs")
    two_sites(spark, s)
    ingest.refresh(s, pages(spark, [(60, "https://b.com/deep er/p+q", "<h1>Odd name</h1>")]), "t3")
    for kb in ("a.com", "b.com"):
        s.export(kb, f"{root}/{kb}")
    bad = tmp_path / "kbs"
    for name, text in (("broken", "{"), ("newer", json.dumps({"schema_version": 9, "id": "n", "name": "N", "source_url": "u", "page_count": 1})), ("poor", json.dumps({"schema_version": 1, "id": "p"})), ("typed", json.dumps({"schema_version": "x", "id": "t", "name": "T", "source_url": "u", "page_count": 1}))):
        (bad / name).mkdir()
        (bad / name / "manifest.json").write_text(text)
    (bad / "broken" / "toc.json").write_text('{"sections": [{"title": "no path"}]}')
    (bad / "poor" / "toc.json").write_text(json.dumps({"sections": [{"title": "T", "path": "gone", "source_url": "u", "children": [{"title": "C", "path": "c", "children": [{"title": "D", "path": "d"}]}]}]}))
    (bad / "a.com" / "artifacts" / "other.txt").write_text("x")
    problems = {r["folder"]: r["problem"] for r in directory.manifests(spark, root).collect()}
    assert problems["a.com"] is problems["b.com"] is None and problems["newer"] == "its version is newer" and problems["poor"] == "name is missing" and problems["broken"] and problems["typed"]
    assert sorted(r["id"] for r in directory.proper(spark, root).collect()) == sorted(m["id"] for m in st.discover(spark, root)) == ["a.com", "b.com"]
    assert [(r["folder"], r["id"], r["name"]) for r in directory.listing(spark, root).filter("folder in ('broken', 'poor')").collect()] == [("broken", "?", "unnamed"), ("poor", "p", "unnamed")]
    got = {(r["folder"], r["path"]): r["markdown"] for r in directory.docs(spark, root).collect()}
    assert got == {(r["kb_id"], r["path"]): r["markdown"] for r in s.table("contents").collect()} and len(got) == 5
    files = {(r["folder"], r["filename"]): r["content"] for r in directory.artifact_files(spark, root).collect()}
    assert set(files) == {(kb, r["filename"]) for kb in ("a.com", "b.com") for r in s.artifact_names(kb).collect()} and files["a.com", "llms.txt"] == s.artifact("a.com", "llms.txt").first()["content"]
    toc = {}
    for r in directory.toc_entries(spark, root).orderBy("folder", "pos").collect():
        toc.setdefault(r["folder"], []).append((r["path"], r["title"], r["depth"]))
    assert toc["a.com"] == st.read_toc(spark, f"{root}/a.com") and toc["poor"] == [("gone", "T", 0), ("c", "C", 1), ("d", "D", 2)] and toc["broken"] == [(None, None, None)]
    assert [tuple(r) for r in directory.missing_files(spark, root).collect()] == [("poor", "gone")]
    nothing = str(tmp_path / "nothing")
    assert directory.manifests(spark, nothing).count() == directory.docs(spark, nothing).count() == directory.toc_entries(spark, nothing).count() == 0
