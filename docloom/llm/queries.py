"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, ann, brown, langid, minhash, mixing, pieces, pii, quality, substrings, templates, warc

MODULES = (pii, quality, brown, minhash, warc, substrings, ann, langid, mixing, pieces, templates, alignment)

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
