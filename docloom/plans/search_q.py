"""Search queries: the index covers titles and paths of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import search
from docloom.plans import pages_q
from docloom.plans.registry import PM, query


def _cte(phrases: list[str], where: str, kb: str | None = None) -> str:
    """SQL for a list of phrases, each a query for (page_id, f), and a condition over f0, f1 and so on."""
    fold = lambda c: f"translate(lower(coalesce({c}, '')), '{text.MARKED}', '{text.PLAIN}')"
    toks = lambda c: rf"regexp_extract_all({fold(c)}, '[\p{{L}}\p{{N}}]+')"
    n = range(len(phrases))
    idf = lambda k: f"CASE WHEN ln((s.n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((s.n - df{k} + 0.5) / (df{k} + 0.5)) END"
    score = " + ".join(f"({idf(k)}) * (f{k} * 2.2) / (f{k} + 1.2 * (0.25 + 0.75 * l.len / s.mean))" for k in n)
    pages = PM if kb is None else PM.replace("pm AS", "every AS", 1) + f", pm AS (SELECT * FROM every WHERE kb_id = '{kb}')"
    return f"""WITH {pages}, a AS (SELECT page_id, 'title' AS col, {toks('title')} AS t FROM pm UNION ALL SELECT page_id, 'path', {toks('path')} FROM pm),
ix AS (SELECT page_id, col, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM a), l AS (SELECT page_id, count(*) AS len FROM ix GROUP BY page_id),
s AS (SELECT count(*) AS n, sum(len) / count(*) AS mean FROM pm LEFT JOIN l USING (page_id)),
{', '.join(f'q{k} AS ({p})' for k, p in enumerate(phrases))},
h AS (SELECT page_id, {', '.join(f'coalesce(q{k}.f, 0) AS f{k}' for k in n)} FROM pm {' '.join(f'LEFT JOIN q{k} USING (page_id)' for k in n)}),
c AS (SELECT {', '.join(f'count(*) FILTER (f{k} > 0) AS df{k}' for k in n)} FROM h)
SELECT h.page_id, pm.kb_id, pm.path, pm.title, round(-({score}), 6) AS score FROM h JOIN l USING (page_id) JOIN pm USING (page_id), s, c WHERE {where} ORDER BY score, page_id LIMIT """


def _word(t: str, more: str = "") -> str:
    return f"SELECT page_id, count(*) AS f FROM ix WHERE token = '{t}' {more} GROUP BY page_id"


def _add(name: str, text_: str, phrases: list[str], where: str, limit: int = 10, kb: str | None = None) -> None:
    sql = _cte(phrases, where, kb) + str(limit)
    query(sql, name)(lambda spark, d: search.search(pages_q.table(spark, d), text_, limit, kb))


_PAIR = "SELECT a.page_id, count(*) AS f FROM ix a JOIN ix b ON a.page_id = b.page_id AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY a.page_id"
_add("search_and", "the of", [_word("the"), _word("of")], "f0 > 0 AND f1 > 0")
_add("search_or", "the OR élan OR de", [_word("the"), _word("elan"), _word("de")], "(f0 > 0 OR f1 > 0 OR f2 > 0)", 50)
_add("search_not", "the NOT of", [_word("the"), _word("of")], "f0 > 0 AND NOT f1 > 0")
_add("search_phrase", '"of the"', [_PAIR], "f0 > 0")
_add("search_prefix", "th*", ["SELECT page_id, count(*) AS f FROM ix WHERE starts_with(token, 'th') GROUP BY page_id"], "f0 > 0", 50)
_add("search_column", "path: en AND title: the", [_word("en", "AND col = 'path'"), _word("the", "AND col = 'title'")], "f0 > 0 AND f1 > 0")
_add("search_common_term", "en", [_word("en")], "f0 > 0", 20)
_add("search_in_kb", "the OR en OR fr OR de OR es", [_word(x) for x in ("the", "en", "fr", "de", "es")], "(f0 > 0 OR f1 > 0 OR f2 > 0 OR f3 > 0 OR f4 > 0)", 10, "ththre.example.com")
_add("search_first", "^the", [_word("the", "AND pos = 0")], "f0 > 0")
_add("search_precedence", "the NOT of and OR de", [_word("the"), _word("of"), _word("and"), _word("de")], "((f0 > 0 AND NOT (f1 > 0 AND f2 > 0)) OR f3 > 0)", 50)
_add("search_near", "NEAR(the of, 2)", ["SELECT a.page_id, count(DISTINCT (a.col, least(a.pos, b.pos), greatest(a.pos, b.pos))) AS f FROM ix a JOIN ix b ON a.page_id = b.page_id AND a.col = b.col WHERE a.token = 'the' AND b.token = 'of' AND greatest(a.pos, b.pos) - (least(a.pos, b.pos) + 1) <= 2 GROUP BY a.page_id"], "f0 > 0", 50)


@query(rf"""WITH {PM}, a AS (SELECT page_id, unnest(regexp_extract_all(translate(lower(coalesce(title, '')), '{text.MARKED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+') || regexp_extract_all(translate(lower(path), '{text.MARKED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+')) AS token FROM pm)
SELECT token, count(*) AS n, count(DISTINCT page_id) AS df FROM a GROUP BY token""")
def term_stats(spark, d):
    return search.postings(pages_q.table(spark, d)).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("df"))
