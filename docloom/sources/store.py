"""The store of knowledge bases: Parquet tables with versions, queries over them, and the directory form.

Rows are dealt to PARTS parts by their knowledge base. A version holds the parts that a write has touched, as
folders, and a list of them that is written last: readers take each part from the newest version that lists it,
and never see half of one. So a write costs what it touches, and a query of one knowledge base reads one part.
Tables: kbs, pages, links, nav, postings, stats, contents, toc, artifacts, cache, jobs.
Spark sizes the files of a part, so a large knowledge base is written by many tasks. Postings are sorted by token, in small row groups with
filters of bits, so a search reads the row groups that hold its words; their lengths and the statistics of the base are stored beside them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.operators import artifacts, concat, search
from docloom.sources.config import ParseError, StorageError, ValidationError

SCHEMA_VERSION = 1
SCHEMAS = {
    "kbs": "kb_id string, name string, source_url string, created_at string, updated_at string, page_count long",
    "pages": "page_id long, kb_id string, url string, path string, title string, content_hash string, content_len long, status_code int",
    "links": "kb_id string, from_page_id long, pos long, href string, to_url string, kind string",
    "postings": "kb_id string, page_id long, len int, col string, pos int, token string",
    "stats": "kb_id string, n long, total long",
    "nav": "kb_id string, page_id long, pos int, title string, path string",
    "contents": "kb_id string, path string, markdown string",
    "toc": "kb_id string, section int, item int, depth int, title string, path string, source_url string",
    "artifacts": "kb_id string, filename string, piece int, at long, content string",
    "cache": "kb_id string, artifact_type string, prompt_hash string, model_id string, result_json string",
    "jobs": "job_id string, kb_id string, started_at string, finished_at string, stats string",
}
#: Parts of each table; versions that stay after a newer whole one, for readers that have begun; partial versions after which a write is whole.
PARTS, KEPT, MOST_VERSIONS = 64, 2, 30
#: Columns by which rows of a part are sorted in their files, and options of the writer.
SORTED = {"postings": ("kb_id", "token", "page_id"), "links": ("kb_id", "from_page_id", "pos"), "contents": ("kb_id", "path"), "pages": ("kb_id", "path")}
WRITTEN = {"postings": {"parquet.block.row.count.limit": "100000", "parquet.bloom.filter.enabled#token": "true", "parquet.bloom.filter.expected.ndv#token": "20000"}}


class Files:
    """Small files of any file system that Spark knows, from the driver."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write(self, path: str, text: str) -> None:
        for _ in self.write_all(path, iter([text.encode()])):
            pass

    def write_all(self, path: str, parts: Iterator[bytes]) -> Iterator[bytes]:
        """Write a file part by part, and give each part on. Whole or not at all: a temporary file takes the name when it is complete."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        out = fs.create(tmp, True)
        for x in parts:
            out.write(bytearray(x))
            yield x
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(tmp, p):
            raise StorageError(f"{path} cannot be written")

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise StorageError(f"{path} does not exist")
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def safe_path(path: str) -> str:
    """A page's path, which must not leave its folder."""
    if path.startswith("/") or ".." in path.split("/") or "\\" in path or not path:
        raise ValidationError(f"bad path: {path!r}")
    return path


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only, self.files = spark, root.rstrip("/"), read_only, Files(spark)

    def _versions(self, name: str) -> list[tuple[str, dict]]:
        """Complete versions with their lists, the newest first."""
        out = []
        for x in sorted(self.files.names(f"{self.root}/{name}"), reverse=True):
            if re.fullmatch(r"v-\d{9}-[0-9a-f]+", x) and self.files.exists(f"{self.root}/{name}/{x}/list.json"):
                out.append((x, json.loads(self.files.read(f"{self.root}/{name}/{x}/list.json"))))
                if out[-1][1]["whole"]:
                    break
        return out

    @staticmethod
    def part(kb_id: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(kb_id, F.lit(""))), F.lit(PARTS)).cast("int")

    def _part(self, kb_id: str) -> int:
        return self.spark.range(1).select(self.part(F.lit(kb_id))).first()[0]

    def table(self, name: str, kb_id: str | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table, or its rows of one knowledge base, or those of some parts."""
        if kb_id is not None:
            return self.table(name, parts=[self._part(kb_id)]).filter(F.col("kb_id") == kb_id)
        where: dict[int, str | None] = {}
        for v, listed in self._versions(name):
            for k in listed["touched"] if not listed["whole"] else range(PARTS):
                where.setdefault(k, f"{self.root}/{name}/{v}/part={k}" if k in listed["there"] else None)
        paths = [x for k, x in sorted(where.items()) if x and (parts is None or k in parts)]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame, parts: list[int] | None = None) -> None:
        """The rows of a table, or of some parts of it, which replace all that these held."""
        if self.read_only:
            raise StorageError("the store is read-only")
        known = self._versions(name)
        if parts is not None and len(known) > MOST_VERSIONS:
            df, parts = self.table(name, parts=[k for k in range(PARTS) if k not in parts]).unionByName(df.select(*self._columns(name))), None
        names = [x for x in self.files.names(f"{self.root}/{name}") if x.startswith("v-")]
        at = f"{self.root}/{name}/v-{max([0, *(int(x[2:11]) for x in names)]) + 1:09d}-{uuid.uuid4().hex[:8]}"  # two writers never share a folder
        rows = df.select(*self._columns(name)).withColumn("part", self.part(F.col("kb_id"))).hint("rebalance", "part")
        rows.sortWithinPartitions("part", *SORTED.get(name, ("kb_id",))).write.options(**WRITTEN.get(name, {})).partitionBy("part").parquet(at)
        there = [int(x[5:]) for x in self.files.names(at) if re.fullmatch(r"part=\d+", x)]
        self.files.write(f"{at}/list.json", json.dumps({"whole": parts is None, "touched": sorted(parts or []), "there": there}))
        self._expire(name)

    @staticmethod
    def _columns(name: str) -> list[str]:
        return [x.split()[0] for x in SCHEMAS[name].split(", ")]

    def _expire(self, name: str) -> None:
        """Delete versions that a whole one has replaced, but for the last few."""
        live = {v for v, _ in self._versions(name)}
        dead = [x for x in sorted(self.files.names(f"{self.root}/{name}")) if x.startswith("v-") and x < min(live) and self.files.exists(f"{self.root}/{name}/{x}/list.json")]
        for x in dead[:-KEPT]:
            self.files.delete(f"{self.root}/{name}/{x}")

    def merge(self, name: str, rows: DataFrame, touched: DataFrame) -> None:
        """Replace the rows of the touched knowledge bases (kb_id); all others keep theirs."""
        parts = [r[0] for r in touched.select(self.part(F.col("kb_id"))).distinct().collect()]  # PARTS numbers at most
        others = self.table(name, parts=parts).join(touched.select("kb_id").distinct(), "kb_id", "left_anti").select(*self._columns(name))
        self.write(name, others.unionByName(rows.select(*self._columns(name))), parts)

    def of(self, name: str, touched: DataFrame) -> DataFrame:
        """Rows of the touched knowledge bases (kb_id)."""
        parts = [r[0] for r in touched.select(self.part(F.col("kb_id"))).distinct().collect()]
        return self.table(name, parts=parts).join(touched.select("kb_id").distinct(), "kb_id", "left_semi").select(*self._columns(name))

    def _replace(self, name: str, kb_id: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Change the rows of one knowledge base's part."""
        k = [self._part(kb_id)]
        self.write(name, change(self.table(name, parts=k)), k)

    def touch(self, kb_id: str, now: str) -> None:
        """Set a knowledge base's time of update."""
        self._known(kb_id)
        self._replace("kbs", kb_id, lambda t: t.withColumn("updated_at", F.when(F.col("kb_id") == kb_id, now).otherwise(F.col("updated_at"))))

    def start_job(self, job_id: str, kb_id: str, now: str) -> None:
        new = self.spark.createDataFrame([(job_id, kb_id, now, None, None)], SCHEMAS["jobs"])
        self._replace("jobs", kb_id, lambda t: t.unionByName(new))

    def finish_job(self, job_id: str, now: str, stats: dict) -> None:
        """Close a job with its counts: pages_fetched, pages_skipped, errors and status."""
        mine = F.col("job_id") == job_id
        job = self.table("jobs").filter(mine).first()
        if job is None:
            raise ValidationError(f"no such job: {job_id}")
        self._replace("jobs", job["kb_id"], lambda t: t.withColumns({"finished_at": F.when(mine, now).otherwise(F.col("finished_at")), "stats": F.when(mine, json.dumps(stats, sort_keys=True)).otherwise(F.col("stats"))}))

    def invalidate_cache(self, kb_id: str) -> None:
        self._replace("cache", kb_id, lambda t: t.filter(~F.col("kb_id").eqNullSafe(kb_id)))

    def delete_page(self, kb_id: str, page_id: int) -> None:
        """Delete a page of a knowledge base with its links and postings; a page of the same id elsewhere stays."""
        for name, col in (("pages", "page_id"), ("links", "from_page_id"), ("nav", "page_id"), ("postings", "page_id")):
            self._replace(name, kb_id, lambda t, col=col: t.filter(~(F.col("kb_id").eqNullSafe(kb_id) & F.col(col).eqNullSafe(page_id))))
        self.merge("stats", search.statistics(self.table("pages", kb_id)), self.spark.createDataFrame([(kb_id,)], "kb_id string"))

    def reindex(self, pages: DataFrame, touched: DataFrame) -> None:
        """Write the postings and statistics of all pages of the touched knowledge bases."""
        self.merge("postings", search.postings(pages), touched)
        self.merge("stats", search.statistics(pages), touched)

    def kb_list(self) -> DataFrame:
        return self.table("kbs").orderBy("name")

    def _known(self, kb_id: str) -> None:
        if self.table("kbs", kb_id).isEmpty():
            raise ValidationError(f"no such knowledge base: {kb_id}")

    def toc(self, kb_id: str) -> DataFrame:
        self._known(kb_id)
        return self.table("toc", kb_id).orderBy("section", "item")

    def page(self, kb_id: str, path: str) -> DataFrame:
        """The page's Markdown and its row, whose columns are null if there is none."""
        safe_path(path)
        row = self.table("pages", kb_id).drop("content_len")
        return self.table("contents", kb_id).filter(F.col("path") == path).join(row, ["kb_id", "path"], "left")

    def search(self, kb_id: str, query: str, limit: int = 10) -> DataFrame:
        self._known(kb_id)
        stats = self.table("stats", kb_id).groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        return search.search(self.table("pages", kb_id), query, limit, index=self.table("postings", kb_id), stats=stats)

    def links(self, kb_id: str, page_id: int) -> DataFrame:
        """Links of a page, in their order."""
        return self.table("links", kb_id).filter(F.col("from_page_id") == page_id).orderBy("pos")

    def artifact(self, kb_id: str, name: str) -> DataFrame:
        if name not in artifacts.NAMES:
            raise ValidationError(f"no such artifact: {name}")
        return concat.whole(self.table("artifacts", kb_id).filter(F.col("filename") == name).withColumnRenamed("piece", "part"), "filename").select("content")

    def artifact_parts(self, kb_id: str, name: str) -> DataFrame:
        """piece, at and content of an artifact, in order: joined they are the artifact."""
        if name not in artifacts.NAMES:
            raise ValidationError(f"no such artifact: {name}")
        return self.table("artifacts", kb_id).filter(F.col("filename") == name).select("piece", "at", "content").orderBy("piece")

    def artifact_names(self, kb_id: str) -> DataFrame:
        return self.table("artifacts", kb_id).filter(F.col("filename").isin(*artifacts.NAMES)).select("filename").distinct().orderBy("filename")

    def resources(self) -> DataFrame:
        """uri, kind and mime of all pages, artifacts and tables of contents."""
        uri = lambda kind, *c: F.concat_ws("/", F.lit(f"kb://{kind}"), *c)
        mime = F.when(F.col("filename").endswith(".md"), "text/markdown").otherwise("text/plain")
        p = self.table("contents").select(uri("page", "kb_id", "path").alias("uri"), F.lit("page").alias("kind"), F.lit("text/markdown").alias("mime"))
        a = self.table("artifacts").filter("piece = 0").select(uri("artifact", "kb_id", "filename").alias("uri"), F.lit("artifact").alias("kind"), mime.alias("mime"))
        t = self.table("toc").select("kb_id").distinct().select(uri("toc", "kb_id").alias("uri"), F.lit("toc").alias("kind"), F.lit("application/json").alias("mime"))
        return p.unionByName(a).unionByName(t)

    def export(self, kb_id: str, folder: str) -> int:
        """Write one knowledge base as a directory: manifest.json, toc.json, docs and artifacts. Returns the number of pages."""
        kb = self.table("kbs", kb_id).first()
        if kb is None:
            raise ValidationError(f"no such knowledge base: {kb_id}")
        f, n = self.files, 0
        for r in self.table("contents", kb_id).orderBy("path").toLocalIterator():
            f.write(f"{folder}/docs/{safe_path(r['path'])}.md", r["markdown"])
            n += 1
        sections: list[dict] = []
        for r in self.toc(kb_id).toLocalIterator():
            e = {k: r[k] for k in ("title", "path", "source_url") if r[k] is not None} | {"children": []}
            (sections if r["item"] == 0 else sections[-1]["children"]).append(e)
        f.write(f"{folder}/toc.json", json.dumps({"sections": sections}, indent=2, ensure_ascii=False))
        meta: dict[str, dict] = {}
        for r in self.table("artifacts", kb_id).select("filename").distinct().collect():  # a name for each kind of artifact
            name = r["filename"]
            digest, size = sha256(), 0

            def parts(name: str = name) -> Iterator[bytes]:
                for p in self.artifact_parts(kb_id, name).toLocalIterator():
                    yield p["content"].encode()

            for x in f.write_all(f"{folder}/artifacts/{name}", parts()):
                digest.update(x)
                size += len(x)
            meta[name] = {"sha256": digest.hexdigest(), "size_bytes": size}
        f.write(f"{folder}/manifest.json", json.dumps({
            "schema_version": SCHEMA_VERSION, "id": kb_id, "name": kb["name"], "source_url": kb["source_url"], "tool_version": artifacts.TOOL,
            "created_at": kb["created_at"], "updated_at": kb["updated_at"], "page_count": n, "artifacts": meta, "enrichment": self._enrichment(kb_id),
        }, indent=2, ensure_ascii=False))
        return n

    def _enrichment(self, kb_id: str) -> dict | None:
        """How many results of each kind the knowledge base has, and of which models; null if it has none."""
        rows = self.table("cache", kb_id).groupBy("artifact_type", "model_id").agg(F.count("*").alias("n")).collect()
        kinds: dict[str, int] = {}
        for r in rows:
            kinds[r["artifact_type"]] = kinds.get(r["artifact_type"], 0) + r["n"]
        return {"models": sorted({r["model_id"] for r in rows}), "results": dict(sorted(kinds.items()))} if rows else None


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """A directory's manifest: missing fields, other types and newer versions are errors; artifacts may be an array or an object."""
    try:
        m = json.loads(Files(spark).read(f"{folder}/manifest.json"))
    except ValueError as e:
        raise ParseError(f"{folder}: {e}") from e
    for k, kind in (("schema_version", int), ("id", str), ("name", str), ("source_url", str), ("page_count", int)):
        if not isinstance(m.get(k), kind):
            raise ParseError(f"{folder}: {k} is missing or no {kind.__name__}")
    if m["schema_version"] > SCHEMA_VERSION:
        raise ParseError(f"{folder}: version {m['schema_version']} is newer than {SCHEMA_VERSION}")
    if isinstance(m.get("artifacts"), list):
        m["artifacts"] = {a["filename"]: {k: v for k, v in a.items() if k != "filename"} for a in m["artifacts"]}
    return m


def discover(spark: SparkSession, root: str) -> list[dict]:
    """Manifests of all directories below a root that have a proper one; none if the root is missing."""
    out = []
    for name in Files(spark).names(root):
        try:
            out.append(read_manifest(spark, f"{root}/{name}"))
        except (ParseError, StorageError):
            continue
    return out


def read_toc(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """Path, title and depth of all entries of a directory's toc.json, of any depth, parents first."""
    out: list[tuple[str, str, int]] = []

    def walk(entries: list[dict], depth: int) -> None:
        for e in entries:
            out.append((e["path"], e["title"], depth))
            walk(e.get("children") or [], depth + 1)

    try:
        walk(json.loads(Files(spark).read(f"{folder}/toc.json"))["sections"], 0)
    except (ValueError, KeyError, TypeError) as e:
        raise ParseError(f"{folder}/toc.json: {e}") from e
    return out


def _entries(entries: list[dict]) -> Iterator[dict]:
    for e in entries:
        yield e
        yield from _entries(e.get("children") or [])


def validate(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Which parts of a directory are right: manifest, toc, docs, version and whether each entry has its file."""
    f = Files(spark)
    out = {"manifest": f.exists(f"{folder}/manifest.json"), "toc": f.exists(f"{folder}/toc.json"), "docs": f.exists(f"{folder}/docs"), "version": False, "files": False}
    if out["manifest"]:
        out["version"] = read_manifest(spark, folder)["schema_version"] == SCHEMA_VERSION
    if out["toc"] and out["docs"]:
        toc = json.loads(f.read(f"{folder}/toc.json"))["sections"]
        pages = [e["path"] for e in _entries(toc) if "source_url" in e]
        out["files"] = all(f.exists(f"{folder}/docs/{safe_path(p)}.md") for p in pages)
    return out


def read_page(spark: SparkSession, folder: str, path: str) -> str:
    return Files(spark).read(f"{folder}/docs/{safe_path(path)}.md")
