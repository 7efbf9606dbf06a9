"""The read side as tools and resources: what a server offers, without a transport.

A tool takes plain arguments and returns ``{"structured": ..., "text": ..., "error": bool}``; wrong
arguments and unknown names give an error result, never an exception.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from docloom.operators import artifacts
from docloom.operators.search import QueryError
from docloom.sources.config import EngineError, ValidationError
from docloom.sources.store import Store, safe_path

LIMIT, MOST = 10, 50


def _tool(f: Callable) -> Callable:
    @wraps(f)
    def run(*args, **kwargs) -> dict:
        try:
            structured, text = f(*args, **kwargs)
            return {"structured": structured, "text": text, "error": False}
        except (EngineError, QueryError) as e:
            return {"structured": None, "text": str(e), "error": True}

    return run


class Service:
    def __init__(self, store: Store) -> None:
        self.store = store

    @_tool
    def kb_list(self):
        rows = [r.asDict() for r in self.store.kb_list().collect()]
        return rows, "\n".join(f"{r['name']} ({r['kb_id']}): {r['page_count']} pages" for r in rows)

    @_tool
    def kb_get_toc(self, kb_id: str):
        sections: list[dict] = []
        for r in self.store.toc(kb_id).toLocalIterator():
            e = {"title": r["title"], "path": r["path"], "source_url": r["source_url"], "children": []}
            (sections if r["item"] == 0 else sections[-1]["children"]).append(e)
        return {"sections": sections}, json.dumps({"sections": sections}, ensure_ascii=False)

    @_tool
    def kb_get_page(self, kb_id: str, path: str):
        r = self.store.page(kb_id, path).first()
        if r is None:
            raise ValidationError(f"no such page: {path}")
        return r.asDict(), r["markdown"]

    @_tool
    def kb_search(self, kb_id: str, query: str, limit: int = LIMIT):
        if not isinstance(query, str) or not query.strip():
            raise ValidationError("the query is empty")
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MOST:
            raise ValidationError(f"the limit must be a whole number from 1 to {MOST}")
        rows = [r.asDict() | {"snippet": ""} for r in self.store.search(kb_id, query, limit).collect()]
        return rows, "\n".join(f"{k}. {r['title'] or r['path']} (score: {r['score']:.2f})" for k, r in enumerate(rows, 1)) or "No results"

    @_tool
    def kb_get_artifact(self, kb_id: str, name: str):
        r = self.store.artifact(kb_id, name).first()
        if r is None:
            raise ValidationError(f"{kb_id} has no {name}")
        return {"name": name, "content": r["content"]}, r["content"]

    def resources(self) -> list[dict]:
        return [r.asDict() for r in self.store.resources().orderBy("uri").collect()]

    @_tool
    def read_resource(self, uri: str):
        """Text of a resource by its address, as ``resources`` lists it."""
        head, _, rest = uri.partition("://")
        kind, _, rest = rest.partition("/")
        kb, _, name = rest.partition("/")
        if head != "kb" or kind not in ("page", "artifact", "toc") or not kb or (kind != "toc" and not name):
            raise ValidationError(f"no such resource: {uri}")
        got = self.kb_get_toc(kb) if kind == "toc" else self.kb_get_page(kb, safe_path(name)) if kind == "page" else self.kb_get_artifact(kb, name)
        if got["error"]:
            raise ValidationError(got["text"])
        return got["structured"], got["text"]

    def counts(self) -> dict[str, int]:
        """Pages of each knowledge base (an extension)."""
        return {r["kb_id"]: r["n"] for r in self.store.table("pages").groupBy("kb_id").agg(F.count("*").alias("n")).collect()}

    names = artifacts.NAMES
