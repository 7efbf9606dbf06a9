"""The jobs as queries: each runs twice over a whole table into one new folder, and returns what is there after that."""

from __future__ import annotations

from docloom.checkpoints import new_path
from docloom.functions import text
from docloom.plans.registry import PM, query
from jobs import document_index, page_sync


@query(rf"""WITH {PM}, r AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS h FROM pages),
t AS (SELECT page_id, CASE WHEN regexp_matches(h, '^https?://') THEN regexp_replace(h, '#.*$', '') WHEN starts_with(h, '/') THEN lower(regexp_extract(base, '^([a-z]+://[^/?#]+)', 1)) || regexp_replace(h, '#.*$', '') END AS u
  FROM r WHERE NOT (starts_with(h, '#') OR starts_with(h, 'javascript:') OR starts_with(h, 'mailto:'))),
l AS (SELECT page_id, list_sort(list_distinct(list(u) FILTER (u IS NOT NULL))) AS links FROM t GROUP BY page_id)
SELECT kb_id, path, url, title, content_hash, content_len, coalesce(links, []) AS links, CAST(1 AS INT) AS version, CAST(0 AS BIGINT) AS batch, 'new' AS status FROM pm LEFT JOIN l USING (page_id)
QUALIFY row_number() OVER (PARTITION BY kb_id, path ORDER BY page_id DESC, url DESC, content_hash DESC) = 1""")
def job1_page_sync(spark, d):
    """All fetched pages as a stream, in two runs: the second finds nothing new."""
    at = new_path(spark, "page-sync")
    for _ in range(2):
        # A pattern, as a stream's source is a folder or a pattern, and the table may be one file.
        out = page_sync.run(spark, f"{d}/pages.parque[t]", f"{at}/versions", f"{at}/checkpoint")
    return out


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{text.MARKED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL)
SELECT term, doc_id, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS doc_len, count(*) OVER (PARTITION BY term) AS df FROM p""")
def job2_document_index(spark, d):
    """The index of all documents, built twice."""
    at = new_path(spark, "document-index")
    for _ in range(2):
        out = document_index.run(spark, f"{d}/documents.parquet", f"{at}/index")
    return out.drop("bucket")
