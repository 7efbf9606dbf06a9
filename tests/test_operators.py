import pytest
from pyspark.sql import functions as F

from docloom.operators import crawl, diff, enrich, search, toc
from docloom.plans import ingest
from docloom.sources import config, llmstxt, store as st
from docloom.streaming import incremental

SITE = [(0, "https://e.org/", '<a href="/a">a</a><h1>Home</h1>'), (1, "https://e.org/a", '<a href="/b">b</a><a href="/">h</a><h1>Installation</h1>'), (2, "https://e.org/b", "<h1>Deep Élan</h1>")]


def pages(spark, rows=SITE):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_bfs_depth_and_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (1, 1)], "src long, dst long")
    start = spark.createDataFrame([(0,), (0,)], "node long")
    walk = lambda n, **k: {r["node"]: r["depth"] for r in crawl.bfs(start, edges, n, **k).collect()}
    assert walk(0) == {0: 0} and walk(1) == {0: 0, 1: 1} and walk(9) == {0: 0, 1: 1, 2: 2}
    assert walk(9, scope=lambda c: c != 1) == {0: 0}


def test_diff(spark):
    s = "kb_id string, path string, content_hash string"
    a = spark.createDataFrame([("k", "same", "1"), ("k", "other", "1"), ("k", "gone", "1")], s)
    b = spark.createDataFrame([("k", "same", "1"), ("k", "other", "2"), ("k", "new", "1"), ("k", "new", "1")], s)
    got = sorted((r["path"], r["status"]) for r in diff.page_diff(a, b).collect())
    assert got == [("gone", "removed"), ("new", "new"), ("new", "new"), ("other", "changed"), ("same", "unchanged")]
    assert diff.summary(diff.page_diff(a, b), prune=False).first()["removed"] == 0
    assert diff.needs_convert(diff.page_diff(a, b, force=True)).count() == 3


def test_toc_order(spark):
    rows = [(1, "k", "b", "B", "u1"), (2, "k", "a/x", "zeta", "u2"), (3, "k", "a/index", "Start", "u3"), (4, "k", "b/c/d", None, "u4"), (5, "k", "index", "Home", "u5")]
    p = spark.createDataFrame(rows, "page_id long, kb_id string, path string, title string, url string")
    got = [(r["section"], r["item"], r["path"]) for r in toc.flat(p).orderBy("section", "item").collect()]
    assert got == [(1, 0, "index"), (2, 0, "a"), (2, 1, "a/index"), (2, 2, "a/x"), (3, 0, "b"), (4, 0, "b/c"), (4, 1, "b/c/d")]
    assert toc.choose(3, 6) == "adapter" and toc.choose(2, 6) == "paths" and toc.choose(0, 0) == "paths"


@pytest.mark.parametrize("q", ["", "   ", "a AND", "(a", "a.b", "c++", "nope: a", '"a', "NOT a", "foo-bar"])
def test_bad_queries(q):
    with pytest.raises(search.QueryError):
        search.parse(q)


def test_search(spark):
    from docloom.sources.pages import page_table

    p = page_table(pages(spark))
    hits = lambda q: [r["page_id"] for r in search.search(p, q).collect()]
    assert hits("installation") == [1] and hits("elan") == [2] and hits("Deep elan") == [2] and hits("inst*") == [1]
    assert hits("home OR deep") == [0, 2] and hits("path: b") == [2] and hits("deep NOT elan") == [] and hits('"elan deep"') == []
    assert hits("deep + elan") == [2] and hits("-title: b") == [2] and hits("{title path}: a") == [1]
    assert search.search(p, "home OR deep OR a", limit=0).count() == 1


def test_llms_parse(spark):
    body = "\n# T\n> one\n> two\n\n- [x](u)\n## S\n- [y](v): note\ntext\n"
    f = spark.createDataFrame([(1, body), (2, "no"), (3, ""), (4, None)], "id long, body string")
    p = llmstxt.parse(f)
    got = {r["id"]: r for r in p.collect()}
    assert (got[1]["ok"], got[1]["title"], got[1]["summary"]) == (True, "T", "one two")
    assert not any(got[i]["ok"] for i in (2, 3, 4))
    assert [(r["section"], r["name"], r["notes"]) for r in llmstxt.entries(p).orderBy("pos").collect()] == [(None, "x", None), ("S", "y", "note")]


def test_retries():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("503 unavailable")
        return "ok"

    assert enrich.with_retries(flaky, sleep=waits.append)("p") == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        enrich.with_retries(lambda x: (_ for _ in ()).throw(ValueError("bad request")), sleep=waits.append)("p")


def test_config(tmp_path):
    assert config.load(tmp_path / "none.toml").crawl.depth == 3
    assert config.init(tmp_path / "c.toml").crawl.concurrency == 4
    (tmp_path / "bad.toml").write_text("[crawl]\nfoo = 1\n")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "bad.toml")


def test_store_round_trip(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    ingest.add(s, pages(spark), "2026-01-01T00:00:00Z")
    assert [r["page_count"] for r in s.kb_list().collect()] == [3]
    assert [r["path"] for r in s.search("e.org", "installation").collect()] == ["a"]
    assert "# Home" in s.page("e.org", "index").first()["markdown"]
    assert s.artifact_names("e.org").count() == 6 and s.resources().count() == 3 + 6 + 1
    assert "- [Installation](https://e.org/a)" in s.artifact("e.org", "llms.txt").first()["content"]
    for bad in (lambda: s.artifact("e.org", "x"), lambda: s.page("e.org", "../x"), lambda: s.toc("none")):
        with pytest.raises(config.ValidationError):
            bad()
    out = str(tmp_path / "kbs" / "one")
    assert s.export("e.org", out) == 3
    assert all(st.validate(spark, out).values())
    assert [m["id"] for m in st.discover(spark, str(tmp_path / "kbs"))] == ["e.org"] and st.discover(spark, str(tmp_path / "nothing")) == []
    assert "# Home" in st.read_page(spark, out, "index") and ("a", "Installation", 0) in st.read_toc(spark, out)
    with pytest.raises(config.StorageError):
        st.Store(spark, str(tmp_path / "store"), read_only=True).write("pages", s.table("pages"))


def test_update(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    ingest.add(s, pages(spark), "t1")
    ids = {r["path"]: r["page_id"] for r in s.table("pages").collect()}
    again = [SITE[0], (11, "https://e.org/a", "<h1>Changed</h1>"), (12, "https://e.org/new", "<h1>New</h1>")]
    assert ingest.update(s, pages(spark, again), "t2", prune=True) == {"added": 1, "changed": 1, "unchanged": 1, "removed": 1}
    got = {r["path"]: (r["page_id"], r["title"]) for r in s.table("pages").collect()}
    assert {p: t for p, (_, t) in got.items()} == {"index": "Home", "a": "Changed", "new": "New"} and all(got[p][0] == ids[p] for p in ("index", "a")) and len({i for i, _ in got.values()}) == 3
    assert {r["path"] for r in s.table("contents").collect()} == {"index", "a", "new"}
    assert s.kb_list().first()["created_at"] == "t1"
    with pytest.raises(config.EngineError):
        ingest.update(s, pages(spark, []), "t3")


def test_modes(spark):
    full, none = pages(spark), pages(spark, [])

    def fails():
        raise config.ParseError("bad")

    assert ingest.choose_pages("auto", lambda: none, lambda: full).count() == 3
    assert ingest.choose_pages("anything", fails, lambda: full).count() == 3
    assert ingest.choose_pages("llms-txt", lambda: none, lambda: full).count() == 0
    files = spark.createDataFrame([(1, "# T\n- [a](https://e.org/a)\n- [r](/b)")], "id long, body string")
    assert [r["page_id"] for r in ingest.listed_pages(files, full).collect()] == [1]


def test_stream(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    src = str(tmp_path / "in")
    for k in range(2):
        pages(spark, [SITE[0], (5 + k, f"https://e.org/p{k}", "<h1>P</h1>")]).coalesce(1).write.mode("append").parquet(src)
        incremental.keep_up(incremental.page_stream(spark, src), s, str(tmp_path / "cp")).awaitTermination()
    assert {r["path"] for r in s.table("pages").collect()} == {"index", "p0", "p1"}


def test_a_stream_builds_what_a_batch_builds(spark, tmp_path):
    """Two batches into a stream's base, one of them taken twice, against one add of all pages."""
    one, many = st.Store(spark, str(tmp_path / "one")), st.Store(spark, str(tmp_path / "many"))
    src = str(tmp_path / "in")
    batches = [[SITE[0], SITE[1], (7, "https://f.org/x", "<h1>Other</h1><p>old")], [SITE[2], (8, "https://f.org/x", '<h1>Other</h1><p>new</p><a href="/y">y</a>'), (9, "https://f.org/y/z", "<h1>Deep</h1>")]]
    for rows in batches:
        pages(spark, rows).coalesce(1).write.mode("append").parquet(src)
        incremental.keep_up(incremental.page_stream(spark, src), many, str(tmp_path / "cp"), lambda: "t1").awaitTermination()
    ingest.refresh(many, pages(spark, batches[1]), "t1")
    ingest.add(one, pages(spark, [SITE[0], SITE[1], *batches[1]]), "t1")
    for kb in ("e.org", "f.org"):
        a, b = state(one, kb), state(many, kb)
        for name in ("kbs", "pages", "links", "postings", "stats", "contents", "toc"):
            assert a[name] == b[name] and a[name], (kb, name)
    assert [r["path"] for r in many.search("f.org", "deep").collect()] == ["y/z"] and "new" in many.page("f.org", "x").first()["markdown"]


def test_equal_tasks_are_asked_once(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def model(prompt):
        with open(asked, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise ValueError("no")
        return f"answer to {prompt}"

    rows = [("k", "s", f"h{i % 7}", "m", f"c{i % 7}") for i in range(70)] + [("k", "s", "hb", "m", "bad"), ("k", None, "h0", "m", "c0"), ("k", "s", "known", "m", "x")]
    t = spark.createDataFrame(rows, "kb_id string, artifact_type string, prompt_hash string, model_id string, content string").repartition(8)
    c = spark.createDataFrame([("k", "s", "known", "m", "there")], "kb_id string, artifact_type string, prompt_hash string, model_id string, result_json string")
    done = enrich.complete(t, c, model)
    got = {(r["artifact_type"], r["prompt_hash"]): r["result"] for r in done.collect()}
    assert done.count() == 73 and got["s", "h3"] == "answer to c3" and got["s", "hb"] is None and got["s", "known"] == "there" and got[None, "h0"] == "answer to c0"
    calls = [x.strip() for x in open(asked)]
    assert sorted(calls) == sorted([f"c{i}" for i in range(7)] + ["bad", "c0"])
    assert enrich.stats(done).first().asDict()["hits"] == 1


def test_cache_hits(spark):
    t = spark.createDataFrame([("k", "s", "h1", "m", "A b"), ("k", "s", "h2", "m", "C")], "kb_id string, artifact_type string, prompt_hash string, model_id string, content string")
    c = spark.createDataFrame([("k", "s", "h1", "m", "known")], "kb_id string, artifact_type string, prompt_hash string, model_id string, result_json string")
    got = enrich.stats(enrich.complete(t, c)).first().asDict()
    assert got == {"hits": 1, "misses": 1, "tokens_in": 1, "tokens_out": 1}


def test_service(spark, tmp_path):
    from docloom.plans.service import Service

    s = st.Store(spark, str(tmp_path / "store"))
    ingest.add(s, pages(spark), "t1")
    v = Service(s)
    assert v.kb_list()["structured"][0]["page_count"] == 3 and v.counts() == {"e.org": 3}
    assert [x["path"] for x in v.kb_get_toc("e.org")["structured"]["sections"]] == ["index", "b", "a"]
    assert v.kb_search("e.org", "installation")["text"].startswith("1. Installation (score: -")
    for bad in (v.kb_search("e.org", " "), v.kb_search("e.org", "a", 51), v.kb_search("e.org", "a", True), v.kb_search("e.org", "a.b"), v.kb_search("x", "a"), v.kb_get_page("e.org", "none"), v.kb_get_page("e.org", "a/../b"), v.kb_get_artifact("e.org", "z"), v.kb_get_toc("x")):
        assert bad["error"] and bad["text"]
    assert all(v.read_resource(r["uri"])["text"] for r in v.resources())
    assert v.read_resource("kb://page/e.org/../a")["error"] and v.read_resource("http://x")["error"]
    assert v.kb_get_page("e.org", "a")["text"] == v.read_resource("kb://page/e.org/a")["text"]


def test_store_rows(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    ingest.add(s, pages(spark), "t1")
    s.touch("e.org", "t2")
    assert s.kb_list().first()["updated_at"] == "t2" and s.kb_list().first()["created_at"] == "t1"
    s.start_job("j", "e.org", "t1")
    s.finish_job("j", "t2", {"pages_fetched": 3, "status": "completed"})
    assert s.table("jobs").first()["stats"] == '{"pages_fetched": 3, "status": "completed"}'
    assert s.table("cache").count() > 0
    s.invalidate_cache("e.org")
    assert s.table("cache").count() == 0
    s.delete_page("e.org", s.table("pages").filter("path = 'a'").first()["page_id"])
    assert s.table("pages").count() == 2
    with pytest.raises(config.ValidationError):
        s.finish_job("none", "t", {})


def test_command_line(spark, tmp_path):
    import io

    from docloom import cli

    src, root = str(tmp_path / "in"), str(tmp_path / "store")
    pages(spark).write.parquet(src)
    run = lambda *a: (cli.main(["--store", root, *a], spark, out := io.StringIO()), out.getvalue())
    assert run("add", src, "--now", "t1") == (0, "")
    assert run("update", src, "--now", "t2")[1].startswith('{"added": 0, "changed": 0, "unchanged": 3')
    assert "3 pages" in run("list")[1] and "Installation" in run("search", "e.org", "inst*")[1]
    assert run("export", str(tmp_path / "kb"), "e.org") == (0, "3\n") and run("validate", str(tmp_path / "kb"))[0] == 0
    assert run("search", "none", "x")[0] == 1


def test_parsed_precedence():
    shape = lambda n: n.leaf if n.kind == "leaf" else (n.kind, *map(shape, n.parts))
    tree = lambda q: shape(search.parse(q)[0])
    assert tree("a NOT b c") == ("not", 0, ("and", 1, 2)) and tree("a b OR c") == ("or", ("and", 0, 1), 2)
    assert tree("a OR b NOT c") == ("or", 0, ("not", 1, 2)) and tree("c NOT a NOT b") == ("not", ("not", 0, 1), 2)
    assert tree("a NOT b AND c") == ("and", ("not", 0, 1), 2) and tree("a and b") == ("and", 0, 1, 2)


def two_sites(spark, store):
    ingest.add(store, pages(spark, [(0, "https://a.com/", "<h1>A home</h1>"), (1, "https://a.com/x", '<h1>Alpha</h1><a href="/">h</a>')]), "t1")
    ingest.add(store, pages(spark, [(10, "https://b.com/", "<h1>B home</h1>"), (11, "https://b.com/y", '<h1>Beta</h1><a href="/">h</a><a href="https://a.com/x">a</a>')]), "t2")


def state(store, kb):
    names = [n for n in st.SCHEMAS if n != "jobs"]
    return {n: sorted(map(repr, store.table(n, kb).collect())) for n in names}


def test_knowledge_bases_do_not_touch_each_other(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    two_sites(spark, s)
    assert [r["kb_id"] for r in s.kb_list().collect()] == ["a.com", "b.com"]
    a = state(s, "a.com")
    assert len(a["pages"]) == len(a["contents"]) == 2 and len(a["artifacts"]) == 6 and a["links"] and a["postings"] and a["toc"]
    kept = s.table("pages", "b.com").filter("path = 'y'").first()["page_id"]
    again = pages(spark, [(20, "https://b.com/y", "<h1>Beta two</h1>")])
    assert ingest.update(s, again, "t3", prune=True) == {"added": 0, "changed": 1, "unchanged": 0, "removed": 1}
    assert state(s, "a.com") == a and s.table("pages", "b.com").first()["page_id"] == kept and s.table("links", "b.com").isEmpty()
    assert ingest.update(s, pages(spark, [(30, "https://b.com/z", "<h1>Z</h1>")]), "t4")["removed"] == 0
    assert {r["path"] for r in s.table("pages", "b.com").collect()} == {"y", "z"} and {r["path"] for r in s.table("contents", "b.com").collect()} == {"z"}
    ingest.add(s, pages(spark, [(40, "https://b.com/only", "<h1>Only</h1>")]), "t5")
    assert {r["path"] for r in s.table("pages", "b.com").collect()} == {"only"} and state(s, "a.com") == a
    s.touch("b.com", "t6")
    s.invalidate_cache("b.com")
    s.delete_page("b.com", s.table("pages", "b.com").first()["page_id"])
    assert state(s, "a.com") == a and s.table("pages", "b.com").isEmpty() and s.table("postings", "b.com").isEmpty()


def test_stream_keeps_other_knowledge_bases(spark, tmp_path):
    s = st.Store(spark, str(tmp_path / "store"))
    two_sites(spark, s)
    a = state(s, "a.com")
    pages(spark, [(50, "https://b.com/s", "<h1>Streamed</h1>")]).write.parquet(str(tmp_path / "in"))
    incremental.keep_up(incremental.page_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination()
    assert state(s, "a.com") == a and {r["path"] for r in s.table("pages", "b.com").collect()} == {"index", "y", "s"}
    assert [r["path"] for r in s.search("b.com", "streamed").collect()] == ["s"]


def test_search_of_one_knowledge_base_has_its_own_statistics(spark, tmp_path):
    one, both = st.Store(spark, str(tmp_path / "one")), st.Store(spark, str(tmp_path / "both"))
    two_sites(spark, both)
    ingest.add(one, pages(spark, [(0, "https://a.com/", "<h1>A home</h1>"), (1, "https://a.com/x", "<h1>Alpha</h1>")]), "t1")
    rows = lambda s, q: [tuple(r) for r in s.search("a.com", q).collect()]
    assert rows(one, "home OR x OR alpha") == rows(both, "home OR x OR alpha") != []
    from docloom.operators import search as find

    assert [tuple(r) for r in find.search(both.table("pages"), "home OR x OR alpha", kb_id="a.com").collect()] == rows(one, "home OR x OR alpha")


def test_whole_knowledge_base_is_enriched(spark, tmp_path):
    s, asked, steps = st.Store(spark, str(tmp_path / "store")), str(tmp_path / "asked"), []

    def model(prompt):
        with open(asked, "a") as f:
            f.write(f"{len(prompt.encode())}\n")
        return prompt if prompt.startswith("- ") else "sum of " + prompt.split()[1]

    rows = [(i, f"https://e.org/p{i:03d}", f"<h1>T{i}</h1><p>{'long text ' * 3000}</p>") for i in range(3)] + [(i, f"https://e.org/p{i:03d}", f"<h1>T{i}</h1>") for i in range(3, 400)]
    ingest.add(s, pages(spark, rows), "t1", call=model, model="m1", told=steps.append)
    assert steps == ["pages", "contents", "enrichment", "artifacts", "done"]
    rules = s.artifact("e.org", "rules.md").first()["content"]
    assert "- p000: sum of T0" in rules and "- p399" not in rules and len(rules.encode()) < ingest.CONTEXT + 500
    assert "- p001" in s.artifact("e.org", "SKILL.md").first()["content"]
    sizes = [int(x) for x in open(asked)]
    assert len(sizes) == 2 * 400 + 4 and 11_000 < max(sizes) < 13_000
    out = str(tmp_path / "kb")
    s.export("e.org", out)
    assert st.read_manifest(spark, out)["enrichment"]["models"] == ["m1"] and st.read_manifest(spark, out)["enrichment"]["results"]["skill"] == 1


def test_versions_expire(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "MOST_VERSIONS", 3)
    s = st.Store(spark, str(tmp_path / "store"))
    for k in range(12):
        s.start_job(f"j{k}", f"kb{k % 5}", "t")
    assert s.table("jobs").count() == 12 and s.table("jobs", "kb0").count() == 3
    assert len([x for x in s.files.names(f"{s.root}/jobs") if x.startswith("v-")]) <= 3 + 2 + st.KEPT


def ids_of(store):
    return {(r["kb_id"], r["path"]): r["page_id"] for r in store.table("pages").collect()}


def test_page_ids_last_over_fetches_with_numbers_of_their_own(spark, tmp_path):
    """Two sites are fetched apart with the same numbers, and together with others: ids stay, and each index has words of its own pages only."""
    s = st.Store(spark, str(tmp_path / "store"))
    ingest.add(s, pages(spark, [(1, "https://a.com/x", "<h1>Alpha</h1><a href='/y'>y</a>"), (2, "https://a.com/y", "<h1>Beta</h1>")]), "t1")
    ingest.add(s, pages(spark, [(1, "https://b.com/x", "<h1>Gamma</h1><a href='/z'>z</a>"), (2, "https://b.com/z", "<h1>Delta</h1>")]), "t1")
    first = ids_of(s)
    assert len(set(first.values())) == 4
    again = [(1, "https://a.com/new", "<h1>New page</h1>"), (2, "https://a.com/x", "<h1>Alpha</h1>"), (3, "https://a.com/y", "<h1>Beta two</h1>"), (4, "https://b.com/x", "<h1>Gamma</h1><a href='/z'>z</a>"), (5, "https://b.com/z", "<h1>Delta</h1>")]
    assert ingest.update(s, pages(spark, again), "t2") == {"added": 1, "changed": 2, "unchanged": 2, "removed": 0}
    now = ids_of(s)
    assert len(set(now.values())) == 5 and all(now[k] == first[k] for k in first)
    hits = lambda kb, q: [r["path"] for r in s.search(kb, q).collect()]
    assert hits("a.com", "gamma") == [] and hits("a.com", "new") == ["new"] and hits("a.com", "two") == ["y"] and hits("b.com", "gamma") == ["x"] and hits("b.com", "alpha") == []
    postings = s.table("postings").select("kb_id", "page_id").distinct().collect()
    assert {(r["kb_id"], r["page_id"]) for r in postings} == {(kb, i) for (kb, _), i in now.items()}
    assert {(r["kb_id"], r["from_page_id"]) for r in s.table("links").collect()} == {("b.com", now["b.com", "x"])}
    b = state(s, "b.com")
    s.delete_page("a.com", now["a.com", "x"])
    assert state(s, "b.com") == b and ("a.com", "x") not in ids_of(s) and hits("a.com", "alpha") == []
    ingest.add(s, pages(spark, [(9, "https://a.com/x", "<h1>Alpha again</h1>")]), "t3")
    assert ids_of(s)["a.com", "x"] == first["a.com", "x"]


def test_colliding_page_keys_are_told_apart(spark):
    from docloom.operators import identity

    few = lambda kb, path, k: F.pmod(identity.page_key(kb, path, k), F.lit(5))
    known = spark.createDataFrame([("k", "p0", 3), ("k", "gone", 4), ("l", "p0", 1)], "kb_id string, path string, page_id long")
    new = spark.createDataFrame([("k", f"p{i}") for i in range(4)] * 2 + [("l", "p1")], "kb_id string, path string")
    got = [tuple(r) for r in identity.identify(new, known, few).select("kb_id", "path", "page_id").collect()]
    assert len(got) == 5 and len({(kb, i) for kb, _, i in got}) == 5 and ("k", "p0", 3) in got and all(i != 4 for kb, p, i in got if kb == "k")
    assert sorted(got) == sorted(tuple(r) for r in identity.identify(new, known, few).select("kb_id", "path", "page_id").collect())
    assert identity.identify(new.limit(0), known).count() == 0
    nulls = spark.createDataFrame([(None, None), ("", "")], "kb_id string, path string")
    assert len({r["page_id"] for r in identity.identify(nulls.filter("kb_id is not null"), known.limit(0)).collect()}) == 1
    from docloom.sources.config import StorageError

    with pytest.raises(StorageError):
        identity.identify(new, known.limit(0), lambda kb, path, k: F.lit(1).cast("long")).collect()


def plain_crawl(start, responses, most_depth, inside, links):
    """One queue, one URL after another."""
    queue, seen, out, skipped, errors = [(start, 0)], set(), {}, 0, 0
    while queue:
        (url, depth), queue = queue[0], queue[1:]
        if url in seen:
            skipped += 1
            continue
        seen.add(url)
        if not inside(url):
            skipped += 1
            continue
        at, hops = url, 0
        while at in responses and 300 <= responses[at][0] < 400 and responses[at][1] and hops <= 5:
            at, hops = responses[at][1], hops + 1
        status = responses[at][0] if at in responses else None
        outcome = "too_many_redirects" if hops > 5 else "missing" if status is None else "fetched" if 200 <= status < 300 else "http_error"
        out[url] = (depth, outcome)
        if outcome != "fetched":
            errors += 1
            skipped += 1
        elif depth < most_depth:
            queue += [(x, depth + 1) for x in links[at]]
    return out, sum(o == "fetched" for _, o in out.values()), skipped, errors


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_equals_a_plain_queue(spark, seed):
    import random

    from docloom.functions import urls

    rng = random.Random(seed)
    name = lambda k: f"https://e.org/p/{k}" if k % 9 else f"https://e.org/q/{k}"
    responses, links = {}, {}
    for k in range(120):
        kind = rng.random()
        moved = name(k + 1) if k % 10 < 8 and kind < 0.3 else None  # long runs of redirects, too
        responses[name(k)] = (301 if moved else 404 if kind < 0.4 else 200, moved)
        links[name(k)] = [name(rng.randrange(140)) for _ in range(rng.randrange(6))] + (["https://f.org/x"] if k % 7 == 0 else [])
    responses[name(0)] = (200, None)
    responses[name(1)] = (302, name(2))
    responses[name(2)] = (302, name(1))
    links[name(0)] += [name(1), name(3), name(3)]
    rows = [(u, s, "".join(f'<a href="{x}#t">x</a>' for x in links[u]), to) for u, (s, to) in responses.items()]
    df = spark.createDataFrame(rows, "url string, status_code int, html string, location string")
    start = spark.createDataFrame([("https://e.org/q/0/#top",)], "url string")
    for depth in (0, 1, 4):
        want, fetched, skipped, errors = plain_crawl(name(0), responses, depth, lambda u: u.startswith("https://e.org/"), links)
        outcomes, pages, counts = crawl.crawl(start, crawl.fetch_from(df), depth, lambda u: urls.in_scope(u, F.lit("e.org")))
        assert {r["url"]: (r["depth"], r["outcome"]) for r in outcomes.collect()} == want
        assert counts == {"pages_fetched": fetched, "pages_skipped": skipped, "errors": errors, "status": "completed_with_errors" if errors else "completed"}
        assert pages.count() == fetched
    none = crawl.crawl(start.limit(0), crawl.fetch_from(df))
    assert none[0].count() == none[1].count() == 0 and none[2]["pages_fetched"] == 0


def test_listed_pages_that_fail_are_rows(spark):
    rows = [("https://e.org/a", 200, "<p>x", None), ("https://e.org/big", 200, "y" * 100, None), ("https://e.org/r", 301, None, "/a"), ("https://e.org/e", 500, "z", None), ("https://e.org/n", 200, None, None)]
    responses = spark.createDataFrame(rows, "url string, status_code int, html string, location string")
    wanted = spark.createDataFrame([(k, u) for k, u in enumerate(["https://e.org/a#f", "https://e.org/big", "https://e.org/r", "https://e.org/e", "https://e.org/none", "http://localhost/x", None, "https://e.org/a", "https://e.org/n"])], "k int, url string")
    got = {r["k"]: (r["outcome"], r["status_code"], r["html"]) for r in crawl.fetch_listed(wanted, responses, most_bytes=50).collect()}
    assert got == {0: ("fetched", 200, "<p>x"), 1: ("too_large", 200, None), 2: ("fetched", 200, "<p>x"), 3: ("http_error", 500, None), 4: ("missing", None, None), 5: ("refused", None, None), 6: ("refused", None, None), 7: ("fetched", 200, "<p>x"), 8: ("fetched", 200, "")}


def test_listed_urls_get_their_own_response(spark):
    from docloom.operators import crawl

    rows = [("https://e.org/a", 404, "x", None), ("https://e.org/a/#f", 200, "y", None), ("https://e.org/b/", 200, "z", None), ("https://e.org/c", 200, "w", None), ("https://e.org/r", 301, None, "/a"), ("https://e.org/s/", 302, None, "/b#t"), ("https://e.org", 200, "o", None)]
    responses = spark.createDataFrame(rows, "url string, status_code int, html string, location string")
    wanted = ["https://e.org/a", "https://e.org/a/", "https://e.org/b", "https://e.org/b/", "https://e.org/c/", "https://e.org/r", "https://e.org/s", "https://e.org/", "https://e.org/d/"]
    got = {r["url"]: (r["outcome"], r["html"]) for r in crawl.fetch_listed(spark.createDataFrame([(u,) for u in wanted], "url string"), responses).collect()}
    want = [("http_error", None), ("fetched", "y"), ("fetched", "z"), ("fetched", "z"), ("fetched", "w"), ("http_error", None), ("fetched", "z"), ("fetched", "o"), ("missing", None)]
    assert got == dict(zip(wanted, want))


def test_filter_of_urls_loses_none(spark):
    keys = spark.range(500).select(F.concat(F.lit("u"), "id").alias("k"))
    table = spark.range(20000).select(F.concat(F.lit("u"), "id").alias("c"))
    kept = {r["c"] for r in crawl.url_filter(keys, "k", 500)(table, "c").collect()}
    assert {f"u{i}" for i in range(500)} <= kept and len(kept) < 5000


def test_ordered_parts_joined_are_the_whole(spark):
    import random

    from docloom.operators import artifacts, concat

    rng = random.Random(4)
    rows = [(None if k % 50 == 0 else f"kb{min(k % 9, 3)}", f"p{k:04d}", rng.choice([None, "", "é" * rng.randrange(40), "x" * rng.randrange(90)])) for k in range(900)]
    df = spark.createDataFrame(rows, "kb string, ord string, t string").repartition(7)
    want = {}
    for kb, _, t in sorted(rows, key=lambda r: r[1]):
        want[kb] = want.get(kb, "") + (t or "")
    for most in (1, 100, 10**9):
        parts = concat.in_parts(df, "kb", ["ord"], "t", most).collect()
        got = {}
        for r in sorted(parts, key=lambda r: r["part"]):
            assert r["at"] == len(got.get(r["kb"], "").encode()) and len(r["content"].encode()) < most + 200
            got[r["kb"]] = got.get(r["kb"], "") + r["content"]
        assert got == want
        assert {r["kb"]: r["content"] for r in concat.whole(concat.in_parts(df, "kb", ["ord"], "t", most), "kb").collect()} == want
    assert len(parts) == len(want) and concat.in_parts(df.limit(0), "kb", ["ord"], "t").count() == 0
    kbs = spark.createDataFrame([("a", "A", "https://a/"), ("none", "N", "https://n/")], "kb_id string, name string, source_url string")
    pages_ = spark.createDataFrame([("a", k, f"T{k}", f"u{k}", f" body {k} ") for k in range(30)], "kb_id string, ord long, title string, url string, content string")
    one = artifacts.llms_full_txt(pages_, kbs).collect()
    many = concat.whole(artifacts.llms_full_parts(pages_, kbs, 64), "kb_id").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in many] and "- [T2](#t2)" in one[0]["content"] and len(one) == 1


def test_search_reads_the_row_groups_of_its_words(spark, tmp_path, monkeypatch):
    """Stored postings are sorted by token and carry lengths: a rare word is in few row groups, and scores equal those over the page table."""
    import glob

    import pyarrow.parquet as pq

    from docloom.operators import search as find

    monkeypatch.setitem(st.WRITTEN, "postings", st.WRITTEN["postings"] | {"parquet.block.row.count.limit": "5000"})
    s = st.Store(spark, str(tmp_path / "store"))
    words = [f"w{k:05d}" for k in range(60000)]
    rows = [("big.org", i, " ".join(words[i * 20 : i * 20 + 20] + ["common"]), f"p/{i}") for i in range(3000)]
    p = spark.createDataFrame(rows, "kb_id string, page_id long, title string, path string")
    touched = spark.createDataFrame([("big.org",)], "kb_id string")
    s.merge("pages", p.withColumns({"url": F.lit("u"), "content_hash": F.lit("h"), "content_len": F.lit(1).cast("long"), "status_code": F.lit(200)}), touched)
    s.merge("kbs", spark.createDataFrame([("big.org", "b", "u", "t", "t", 3000)], st.SCHEMAS["kbs"]), touched)
    s.reindex(s.of("pages", touched), touched)
    groups = []
    for f in glob.glob(f"{tmp_path}/store/postings/*/part=*/*.parquet"):
        m = pq.ParquetFile(f).metadata
        at = m.schema.names.index("token")
        groups += [(m.row_group(g).column(at).statistics.min, m.row_group(g).column(at).statistics.max) for g in range(m.num_row_groups)]
    hold = lambda w: sum(a <= w <= b for a, b in groups)
    assert len(groups) >= 3 and hold("w31234") == 1
    for q in ("w00042", "common w00100", "w0004*", "w00001 OR w59999", '"w00020 w00021"'):
        got = s.search("big.org", q).collect()
        assert got and got == find.search(p, q).collect()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = s.search("big.org", "w00042")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(token,w00042)" in plan
    assert s.table("stats", "big.org").first()["n"] == 3000
    s.delete_page("big.org", 0)
    assert s.table("stats", "big.org").first()["n"] == 2999 and s.search("big.org", "w00003").count() == 0


def test_navigations_of_pages_become_one_order(spark):
    from docloom.operators import navigation

    menu = lambda kb, page, names: [(kb, page, k, n.split(":")[-1].upper() if ":" in n else n.title(), n.split(":")[0]) for k, n in enumerate(names)]
    rows = menu("k", 1, ["a", "a/1", "a/2", "b", "c"]) + menu("k", 2, ["a", "b", "b/1", "b/2", "c"]) + menu("k", 3, ["a", "b", "b/1", "b/2", "c"]) + menu("k", 4, ["a", "b", "c", "c/1"])
    rows += menu("k", 5, ["new", "a", "b", "c"]) + menu("l", 1, ["x", "y", "x"]) + menu("l", 2, ["y:other", "x"]) + menu("l", 3, ["y:other"]) + [("l", 4, 0, "none", None)]
    nav = spark.createDataFrame(rows, "kb_id string, page_id long, pos int, title string, path string")
    got = {}
    for r in navigation.merged(nav).orderBy("kb_id", "seq").collect():
        got.setdefault(r["kb_id"], []).append((r["seq"], r["path"], r["title"]))
    assert [p for _, p, _ in got["k"]] == ["new", "a", "a/1", "a/2", "b", "b/1", "b/2", "c", "c/1"] and [s for s, _, _ in got["k"]] == list(range(1, 10))
    assert [p for _, p, _ in got["l"]] == ["y", "x"] and got["l"][0][2] == "OTHER"
    assert navigation.merged(nav.limit(0)).count() == 0


GENERATED = {
    "docusaurus": ('<meta name="generator" content="Docusaurus v3"><ul class="menu__list">{}</ul><article><h1>{}</h1></article>', '<li><a class="menu__link" href="/{0}">{1}</a></li>'),
    "vitepress": ('<div id="VPContent"><aside class="VPSidebar">{}</aside><div class="vp-doc"><h1>{}</h1></div></div>', '<a href="/{0}.html">{1}</a>'),
    "gitbook": ('<meta name="gitbook"><aside><nav>{}</nav></aside><section class="markdown-section"><h1>{}</h1></section>', '<a href="/{0}">{1}</a>'),
    "readthedocs": ('<nav class="wy-nav-side"><div class="wy-menu">{}<a href="#here">Here</a></div></nav><div role="main"><h1>{}</h1></div>', '<a href="/{0}.html">{1}</a>'),
    "generic": ("<nav>{}</nav><main><h1>{}</h1></main>", '<a href="/{0}">{1}</a>'),
}


@pytest.mark.parametrize("kind", GENERATED)
def test_toc_follows_the_navigation_of_its_generator(spark, tmp_path, kind):
    page, link = GENERATED[kind]
    s = st.Store(spark, str(tmp_path / "store"))
    order = [("zeta", "Start here"), ("guide/use", "Use"), ("alpha", "Reference")]
    menu = "".join(link.format(p, t) for p, t in order)
    ingest.refresh(s, pages(spark, [(k, f"https://{kind}.org/{p}", page.format(menu, t)) for k, (p, t) in enumerate(order)]), "t")
    got = [(r["path"], r["title"], r["source_url"]) for r in s.toc(f"{kind}.org").collect()]
    if kind == "generic":
        assert [p for p, _, _ in got] == ["guide", "guide/use", "alpha", "zeta"]  # by the paths, in the order of titles
    else:
        assert got == [(p, t, f"https://{kind}.org/{p}") for p, t in order]
