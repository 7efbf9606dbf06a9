"""Main text of pages: against SQL on the given pages, a plain version of the counts, and sites made for it."""

import random
from collections import Counter, defaultdict

import pytest

from docloom.llm import templates
from tests.compare import spark_rows, sql_rows
from tests.conftest import DATA


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, rows, **k):
    return {r["page_id"]: r["text"] for r in templates.main_text(frame(spark, rows), **k).collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_given_pages(spark):
    assert spark_rows(templates.op11_main_text(spark, DATA)) == sql_rows(templates.ORACLES["op11_main_text"], DATA)


def test_counts_alone_find_the_articles(spark):
    """Without any name of an element: only hosts whose pages are many enough have a template, and there the article is left."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    host = lambda u: u.split("/")[2]
    n = Counter(host(u) for _, u, _ in pages)
    want, got = texts(spark, pages), texts(spark, pages, roles=False)
    many = [i for i, u, _ in pages if n[host(u)] >= 5]
    assert len(many) > 40 and sum(got[i] == want[i] for i in many) >= 0.98 * len(many)


def div_site(rng, k, host="s.org"):
    """A page of a site that names nothing: its menu, foot and a box differ or not, its text does."""
    body = "".join(f"<p>{words(rng, 30)}</p>" for _ in range(rng.randrange(2, 6)))
    menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in words(rng, 4).split())
    page = f'<html><body><div class="top"><ul>{menu}</ul></div><div class="x{k}"><div id="c"><h1>T{k} {words(rng, 2)}</h1>{body}</div></div><div class="box">Call us: {words(rng, 3)}</div><div class="end">All rights kept</div></body></html>'
    text = [f"T{k}", body]
    return (k, f"https://{host}/{k}", page), text


def test_site_without_names(spark):
    rng = random.Random(5)
    rows = [div_site(rng, k)[0] for k in range(12)]
    got = texts(spark, rows)
    for k, _, x in rows:
        inner = x.split('<div id="c">')[1].split("</div>")[0]
        want = "\n\n".join(t for t in inner.replace("<h1>", "").replace("</h1>", "|").replace("<p>", "").replace("</p>", "|").split("|") if t)
        assert got[k] == want
    one = texts(spark, rows[:1])  # one page has no template
    assert "All rights kept" in one[0] and "T0" in one[0]


def test_copies_and_repeated_passages_stay(spark):
    """Articles that are copies, or share a passage on every page, are no template; what is around them is."""
    rng = random.Random(6)
    line, same = words(rng, 40), words(rng, 60)
    rows = [(k, f"http://h.net/{k}", f"<div>Menu {k % 2}</div><main><h1>A{k}</h1><p>{line}</p><p>{words(rng, 20)}</p></main><div>Foot of all</div>") for k in range(20)]
    rows += [(k, f"http://h.net/{k}", f"<div>Menu {k % 2}</div><article><p>{same}</p></article><div>Foot of all</div>") for k in range(20, 60)]
    got = texts(spark, rows)
    for k, _, x in rows:
        assert got[k] == (same if k >= 20 else got[k]) and (k >= 20 or got[k].startswith(f"A{k}\n\n{line}\n\n")) and "Foot" not in got[k] and "Menu" not in got[k]
    copies = [(k, f"http://c.net/{k}", f"<p>{same}</p><div>{line}</div>") for k in range(9)]  # one page nine times: no template either
    assert set(texts(spark, copies).values()) == {f"{same}\n\n{line}"}


def test_foot_inside_the_main_place(spark):
    rng = random.Random(8)
    rows = [(k, f"http://b.net/{k}", f"<body><h1>A{k}</h1><p>{words(rng, 30)}</p><p>Said by all</p><div>All rights kept</div></body>") for k in range(9)]
    got = texts(spark, rows)
    assert all(x.startswith(f"A{k}\n\n") and x.endswith("Said by all") for k, x in got.items())


@pytest.mark.parametrize("html,want", [
    ("<header>Top</header><nav>menu</nav><article><header><h1>T</h1></header><p>a<br>b &amp; c&#233;<aside>side</aside><p>d<form>f</form><footer>foot</footer></article><footer>x</footer>", "T\n\na b & cé\n\nd"),
    ('<div class="cookie-notice">ok?</div><div id="main-content"><p>one <b>two</b>\n three<script>no()</script></p><div class="share-links"><a href=x>tweet</a></div></div><section id="comments"><article class="comment">troll</article></section>', "one two three"),
    ("<form><div><p>a long text in a form that holds the whole page</p></div></form>", "a long text in a form that holds the whole page"),
    ("<main><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre>a\n  b</pre></main>", "x\n\ny\n\n1\n\n2\n\na b"),
    ("<p>a<svg><title>t</title></svg> b<button>no</button></p><select><option>no</select><noscript><p>no</p></noscript>c", "a b\n\nc"),
    ("<p>x</b>y<i>z</p>q", "xyz\n\nq"), ("plain < text & more", "plain < text & more"), ("<style>p{}</style><!-- c --><title>t</title>", ""), ("", ""), (None, ""),
    ('<div class="content-with-sidebar"><p>text of the page itself</p></div><div class="sidebar">s</div>', "text of the page itself"),
    ("<div class='post'><h1>T</h1><p>b</p></div><div role='navigation'>n</div><div class='ad'>buy</div><div class='shadow address'>kept</div>", "T\n\nb\n\nkept"),
])
def test_one_page(spark, html, want):
    blocks, e = templates.scan(html or "")
    assert "\n\n".join(templates.kept_blocks(blocks, e, frozenset(), frozenset())) == want


def plain_sites(pages):
    """Template hashes and main places of each host by plain counting over all pages."""
    counts, slots, n = defaultdict(list), defaultdict(int), Counter()
    for _, url, x in pages:
        host = url.split("/")[2]
        n[host] += 1
        blocks, e = templates.scan(x)
        zone = [r for r in e.tolist() if r[6] & 1]
        for key, around, chars in templates._counted(e):
            if around:
                slots[host, key, around] += chars
            else:
                counts[host, key].append(zone[0][0] if zone else tuple(blocks))
    often = {(h, k) for (h, k), own in counts.items() if len(own) >= max(3, 0.3 * n[h]) and len(set(own)) >= 3}
    whole = {(h, k): c for (h, k, _), c in slots.items()}
    return often, {(h, k) for (h, k, a), c in slots.items() if c > 0 and c >= 0.5 * whole.get((h, a), float("inf"))}


def test_counts_equal_plain_ones(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [div_site(random.Random(9), k + 1000)[0] for k in range(9)]
    from pyspark.sql import functions as F

    from docloom.functions import urls

    names = {r["h"]: r["n"] for r in frame(spark, pages).select(urls.host(F.col("url")).alias("n")).distinct().select("n", F.xxhash64("n").alias("h")).collect()}
    often, mains = plain_sites(pages)
    got = templates.sites(templates.parsed(frame(spark, pages))).collect()
    assert {(names[r["host"]], k) for r in got for k in r["template"]} == often and often
    assert {(names[r["host"]], k) for r in got for k in r["mains"]} == mains and mains


def test_defined_results(spark, monkeypatch):
    rows = [(None, None, None), (1, None, "<p>a"), (1, None, "<p>a"), (2, "no url", "<nav>n</nav><p>b"), (3, "https://e.org/", ""), (4, "https://e.org/x", "<div>" * 3000 + "deep" + "<p>w " * 20000)]
    df = frame(spark, rows)
    extra = df.selectExpr("page_id", "url", "html", "'x' AS text", "1 AS HOST", "2 AS blocks")
    got = templates.main_text(extra)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted((r["page_id"] or 0, r["text"][:4], r["n_chars"]) for r in got.collect())
    assert out[:5] == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "b", 1), (3, "", 0)] and out[5][1] == "deep" and out[5][2] == 4 + 20000 * 3
    assert templates.main_text(df.limit(0)).count() == 0
    rng = random.Random(5)
    many = [div_site(rng, k)[0] for k in range(12)] + [(50, None, "<p>z")]
    want = texts(spark, many)
    monkeypatch.setattr(templates, "SENT", 0)  # pages and hosts meet by a shuffle
    assert texts(spark, many) == want


def test_hostile_pages_take_linear_time():
    import time

    for x in ("<div>" * 5000, "<div>a" * 5000, "<li>" * 20000 + "x", "<a>" * 20000 + "x", "<article>" * 3000 + "x", "<svg>" * 20000 + "x", "<nav>x" * 5000 + "</div>" * 20000, "<table><tr><td>x" * 3000):
        began = time.time()
        blocks, e = templates.scan(x)
        templates.kept_blocks(blocks, e, frozenset(), frozenset())
        templates._counted(e)
        assert time.time() - began < 10, x[:20]
