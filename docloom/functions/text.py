"""Folding, digests and small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters with marks and what they fold to; the two strings run in step.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}]+"


def fold(x: Column) -> Column:
    """Lower case without marks, as the search index sees text."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))
