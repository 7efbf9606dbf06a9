"""Crawls: a site fetched level by level with its failures and counts, and plain traversal of a link graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docloom.checkpoints import cut
from docloom.functions import html, urls


def bfs(start: DataFrame, edges: DataFrame, max_depth: int, scope: Callable[[Column], Column] | None = None) -> DataFrame:
    """node and depth of all nodes within ``max_depth`` links of ``start`` (node); the start has depth 0.

    edges: (src, dst). A node counts at its first level. ``scope`` filters what may be visited. There
    are at most ``max_depth`` rounds; each level is written to the shared folder, so that the plan
    does not grow.
    """
    ok = scope if scope is not None else lambda c: F.lit(True)
    level = start.select("node").distinct().filter(ok(F.col("node")))
    seen = cut(level.withColumn("depth", F.lit(0)), "bfs")
    for depth in range(1, max_depth + 1):
        level = seen.filter(F.col("depth") == depth - 1).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        level = cut(level.filter(ok(F.col("node"))).join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def skipped(met: DataFrame, known: DataFrame) -> DataFrame:
    """One row: links (nodes met, null ones aside) and skipped (those known before, and repeats): one shuffle on the node."""
    each = met.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"))
    each = each.join(known.select("node").distinct().withColumn("old", F.lit(1)), "node", "left")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n") - F.when(F.col("old").isNull(), 1).otherwise(0)), F.lit(0)).alias("skipped"))


#: Bytes of a page that are taken at most, and redirects that are followed at most.
MOST_BYTES, MOST_REDIRECTS = 10 << 20, 5
#: Bits of a filter of URLs at most (2^21 rows of 64 bits travel to the tasks); beyond it, more URLs share bits and fewer rows are spared.
MOST_BITS = 1 << 27


def own_names(known: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A function that turns requested URLs in a column of a table into those that have a response (url): their own, else that with or without a slash behind."""
    names = known.groupBy(urls.normalize_url(F.col("url")).alias("__key")).agg(F.min("url").alias("__least"), F.max("url").alias("__most"))

    def name(df: DataFrame, c: str) -> DataFrame:
        met = df.withColumn("__key", urls.normalize_url(F.col(c))).join(names, "__key", "left")
        return met.withColumn(c, F.when(F.col(c) == F.col("__most"), F.col(c)).otherwise(F.coalesce("__least", c))).drop("__key", "__least", "__most")

    return name


def redirected(responses: DataFrame, most: int = MOST_REDIRECTS, names: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """url, target and hops of every response that redirects, by pointer jumping: each round doubles the hops that a row has gone.

    responses: url, status_code, location. A location is resolved against the URL that gives it. A target that still redirects
    after ``most`` hops, as in a loop, has hops beyond ``most``. Targets are normalized, or with ``names`` (see ``own_names``) kept as they are requested.
    """
    first = responses.filter(F.col("status_code").between(300, 399) & F.col("location").isNotNull())
    # Two steps, so that the resolved URL is not worked out again wherever the second one names it.
    first = first.select("url", urls.resolve_any(F.col("url"), F.col("location")).alias("to")).select("url", (urls.requested_url if names else urls.normalize_url)(F.col("to")).alias("target")).filter("target is not null")
    first = names(first, "target") if names else first
    at = cut(first.groupBy("url").agg(F.min("target").alias("target")).withColumn("hops", F.lit(1)), "redirects")
    step = 1
    while step <= most and not at.isEmpty():
        on = at.select(F.col("url").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"))
        at = cut(at.join(on, "target", "left").select("url", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "redirects")
        step *= 2
    return at


def fetch_from(responses: DataFrame, most_bytes: int = MOST_BYTES, most_redirects: int = MOST_REDIRECTS, slashes: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A fetch over responses that are there already (url, status_code, html and location): see ``crawl``.

    Of several responses of a normalized URL the one of the least status, location and hash of its html counts. Every URL that is asked for gives one row: fetched, or why
    not (``missing``: no response; ``http_error``: not 2xx; ``too_many_redirects``; ``too_large``: its html is left out). With ``slashes``
    URLs are told apart by a slash behind, where both have a response.
    """
    all_ = responses.select((urls.requested_url if slashes else urls.normalize_url)(F.col("url")).alias("url"), F.col("status_code").cast("int").alias("status_code"), "location", "html").filter("url is not null")
    all_ = all_.withColumn("mark", F.xxhash64("html"))
    narrow = all_.select("url", "status_code", "location", F.octet_length("html").alias("size"), "mark")
    known = cut(narrow.groupBy("url").agg(F.min(F.struct("status_code", "location", "mark", "size")).alias("r")).select("url", "r.*"), "responses")
    names = own_names(known) if slashes else None
    hops = redirected(known, most_redirects, names)

    def fetch(wanted: DataFrame) -> DataFrame:
        asked = wanted.select("url", F.col("url").alias("own"))
        asked = (names(asked, "own") if names else asked).join(hops.withColumnRenamed("url", "own"), "own", "left").withColumn("target", F.coalesce("target", "own"))
        got = asked.join(known.select(F.col("url").alias("target"), "status_code", "size", "mark", F.lit(True).alias("there")), "target", "left")
        outcome = (
            F.when(F.coalesce("hops", F.lit(0)) > most_redirects, "too_many_redirects").when(F.col("there").isNull(), "missing").when(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)), "http_error")
            .when(F.coalesce("size", F.lit(0)) > most_bytes, "too_large").otherwise("fetched")
        )
        got = cut(got.select("url", "target", outcome.alias("outcome"), F.when(outcome != "too_many_redirects", F.col("status_code")).alias("status_code"), "mark"), "outcomes")
        # Pages move for fetched URLs only: each target's html once.
        due = got.filter("outcome = 'fetched'").select("target", "mark").distinct()
        same = (F.col("r.url") == F.col("d.target")) & F.col("r.mark").eqNullSafe(F.col("d.mark"))
        text = all_.alias("r").join(due.alias("d"), same).select("d.target", "r.html").groupBy("target").agg(F.first("html").alias("html"))
        out = got.join(text, "target", "left")
        return out.select("url", "outcome", "status_code", F.when(F.col("outcome") == "fetched", F.coalesce("html", F.lit(""))).alias("html"))

    return fetch


def fetch_listed(wanted: DataFrame, responses: DataFrame, most_bytes: int = MOST_BYTES, most_redirects: int = 3) -> DataFrame:
    """All rows of listed pages (url and others) with outcome, status_code and html: no row is lost, whatever its fetch came to.

    A URL that cannot be normalised, or must not be fetched, is ``refused``. A response is that of its own URL: one of the same URL but for a trailing slash
    stands in where there is no other.
    """
    named = wanted.withColumn("__at", F.when(~urls.guarded(F.col("url")), urls.requested_url(F.col("url"))))
    got = fetch_from(responses, most_bytes, most_redirects, slashes=True)(named.filter("__at is not null").select(F.col("__at").alias("url")).distinct())
    out = named.join(got.withColumnRenamed("url", "__at"), "__at", "left").drop("__at")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("refused")))


def url_filter(keys: DataFrame, key: str, n: int) -> Callable[[DataFrame, str], DataFrame]:
    """A function that keeps the rows of a table whose column may equal one of n keys; it lets all equal ones through, and few others.

    A filter of 16 bits a key, in words of 64 bits, that is broadcast: MOST_BITS bound its size.
    """
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * max(n, 1)).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word, bit = (lambda c: F.floor(place(c) / 64).cast("long")), (lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int")))
    words = keys.groupBy(word(F.col(key)).alias("__word")).agg(F.bit_or(bit(F.col(key))).alias("__bits"))

    def keep(df: DataFrame, c: str) -> DataFrame:
        met = df.withColumn("__word", word(F.col(c))).join(F.broadcast(words), "__word")
        return met.filter(F.col("__bits").bitwiseAND(bit(F.col(c))) != 0).drop("__word", "__bits")

    return keep


def crawl(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_depth: int = 3, scope: Callable[[Column], Column] | None = None, blocked: Callable[[Column], Column] | None = urls.guarded) -> tuple[DataFrame, DataFrame, dict]:
    """Fetch a site level by level from the start (url): outcomes, pages and counts.

    ``fetch`` takes URLs (url) and gives a row for each: url, outcome (``fetched`` or why not), status_code and html. Outcomes: url (normalized), depth,
    outcome and status_code of every URL asked for. Pages: url, depth and html of those fetched. Counts: pages_fetched, pages_skipped, errors and
    status, as a plain queue has them: every link of a page above the last level is queued; one met before is skipped, and so is one out of
    scope or blocked; a failure is an error and skipped. A URL counts as met before its scope is looked at.

    A level is a delta: its links, counted by URL, against the visited URLs that may equal one of them by a filter of bits, so the visited ones that no
    link can equal do not move. Only counts come to the driver.
    """
    ok = scope if scope is not None else lambda c: F.lit(True)
    bad = blocked if blocked is not None else lambda c: F.lit(False)
    queue = cut(start.select(urls.normalize_url(F.col("url")).alias("url")).filter("url is not null").groupBy("url").agg(F.count("*").alias("n")), "crawl-queue")
    visited, outcomes, pages = None, [], []
    fetched = skipped = errors = 0
    for depth in range(max_depth + 1):
        size = queue.agg(F.count("*").alias("urls"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
        if not size["urls"]:
            break
        new = queue.select("url")
        if visited is not None:
            seen = url_filter(new, "url", size["urls"])(visited, "url").join(new, "url", "left_semi")
            new = new.join(seen, "url", "left_anti")
        new = cut(new.withColumn("inside", F.coalesce(ok(F.col("url")) & ~bad(F.col("url")), F.lit(False))), "crawl-new")
        got = cut(fetch(new.filter("inside").select("url")).select("url", F.lit(depth).alias("depth"), "outcome", "status_code", "html"), "crawl-got")
        n = got.agg(F.count_if(F.col("outcome") == "fetched").alias("fetched"), F.count("*").alias("asked")).first()
        fetched, errors, skipped = fetched + n["fetched"], errors + n["asked"] - n["fetched"], skipped + size["links"] - n["fetched"]
        visited = new.select("url") if visited is None else visited.unionByName(new.select("url"))
        outcomes.append(got.drop("html"))
        pages.append(got.filter("outcome = 'fetched'").select("url", "depth", "html"))
        if depth == max_depth:
            break
        read = html.facts(pages[-1].select("url", "html"), "hrefs")
        links = read.select("url", F.explode(F.filter("hrefs", urls.followable)).alias("href")).select(urls.resolve_any(F.col("url"), F.col("href")).alias("to")).select(urls.normalize_url(F.col("to")).alias("url"))
        queue = cut(links.filter("url is not null").groupBy("url").agg(F.count("*").alias("n")), "crawl-queue")

    def all_of(parts: list[DataFrame], schema: str) -> DataFrame:
        out = parts[0] if parts else start.sparkSession.createDataFrame([], schema)
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    counts = {"pages_fetched": fetched, "pages_skipped": skipped, "errors": errors, "status": "completed_with_errors" if errors else "completed"}
    return all_of(outcomes, "url string, depth int, outcome string, status_code int"), all_of(pages, "url string, depth int, html string"), counts
