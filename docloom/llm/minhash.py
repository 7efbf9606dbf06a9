"""MinHash near-dedup: universal hash minima, banding, verification, and connected components.

Documents of equal shingle sets are one node, however many copies there are. Nodes meet in buckets
of equal bands. A bucket does not give all its pairs: its least member is tested against the others,
and the links found make components. Only in buckets that still hold several components are pairs
across components tested: small buckets give them as rows, large ones are cut into blocks that are
compared inside tasks, each pair in the first of its common buckets, and give links only. So every
pair of a bucket is tested or already in one component, which is all that components need. A test
compares set sizes, then signatures, and at last the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import bitmap, bits_for, cut, freed, table, tune
from .components import components

WORDS = 4
#: 42 bands of 6 rows miss a pair of similarity 0.8 with probability 3e-6, and rarely join pairs under 0.4.
HASHES, ROWS = 252, 6
#: Signatures that agree less are not compared in full: 0.8 less five to six standard deviations.
SIGNATURE_LEAST = 0.66
#: Members of a bucket whose pairs are rows at most; members and bytes of sets of a block at most, on average.
SMALL, BLOCK, BLOCK_BYTES = 8, 256, 2 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_RNG = np.random.default_rng(1)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PART = 4096


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text, lower-cased in A-Z only.

    A text of fewer words is one shingle; a null text or one without words has none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(w) < words:
        m = np.uint64(0)
        for i in range(len(w)):
            m = m * _MULT[4] + h[i : i + 1]
        return _mix(m + np.uint64(len(w)))
    n = len(w) - words + 1
    m = np.zeros(n, np.uint64)
    for k in range(words):
        m = m * _MULT[0] + h[k : k + n]
    return np.unique(_mix(m))


def _mix(m: np.ndarray) -> np.ndarray:
    m = m ^ (m >> np.uint64(32))
    m = m * _MULT[1]
    m = m ^ (m >> np.uint64(29))
    return m * _MULT[2]


def signature(s: np.ndarray) -> bytes:
    """High halves of the least value of each hash function over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _PART):
        part = s[at : at + _PART]
        for k in range(0, HASHES, 18):
            h = _A[k : k + 18, None] * part[None, :]
            h += _B[k : k + 18, None]
            least[k : k + 18] = np.minimum(least[k : k + 18], h.min(1))
    return (least >> np.uint64(32)).astype(np.uint32).tobytes()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, d1, d2, sig = [], [], [], []
        for x in b.column(1).to_pylist():
            s = shingles(x)
            n.append(len(s))
            h = xxhash.xxh3_128_digest(s.tobytes())
            d1.append(int.from_bytes(h[:8], "little", signed=True))
            d2.append(int.from_bytes(h[8:], "little", signed=True))
            sig.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "d1", "d2", "sig"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree enough."""
    for b in batches:
        if b.num_rows:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array((one == two).mean(1) >= SIGNATURE_LEAST))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for b in batches:
        keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components between two blocks of a bucket; a pair that shares an earlier band is left to that one."""
    for b in batches:
        u, v = [], []
        for band, same, left, right in zip(*(b.column(i).to_pylist() for i in range(4))):
            one, two = ((np.array([r["node"] for r in x]), np.array([r["comp"] for r in x]), np.array([r["n"] for r in x]), np.frombuffer(b"".join(r["sig"] for r in x), np.uint32).reshape(-1, HASHES)) for x in (left, right))
            sets = [[np.frombuffer(r["set"], np.uint64) for r in x] for x in (left, right)]
            for i in range(len(one[0])):
                go = np.flatnonzero((two[1] != one[1][i]) & (100 * np.minimum(two[2], one[2][i]) >= 80 * np.maximum(two[2], one[2][i])) & ((two[0] > one[0][i]) | (not same)))
                if not len(go):
                    continue
                equal = two[3][go] == one[3][i]
                near = equal.mean(1) >= SIGNATURE_LEAST
                first = equal[near].reshape(-1, HASHES // ROWS, ROWS).all(2).argmax(1)
                for j in go[near][first == band].tolist():
                    if _similar(sets[0][i], sets[1][j]):
                        u.append(min(int(one[0][i]), int(two[0][j])))
                        v.append(max(int(one[0][i]), int(two[0][j])))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


_PAIR = "u long, v long"


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and full set of the documents of ``ids``: a bitmap of the ids' hashes spares the others, a join is exact."""
    bits = bits_for(ids.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    there = bitmap(ids.select(place("id").alias("p")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).to_numpy()
            b = b.filter(pa.array((there[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            got = [shingles(x).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "set"])

    found = docs.filter("id is not null").select("id", "text", place("id").alias("p")).mapInArrow(freed(run), "id long, set binary")
    return cut(found.join(ids, "id", "left_semi"), "minhash-sets")


def _large_buckets(at: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components inside buckets of many members; rows are pairs of blocks, never of members."""
    full = at.join(nodes.select("node", "n", "sig"), "node").join(sets.select(F.col("id").alias("node"), "set"), "node")
    parts = at.join(nodes.select("node", "n"), "node").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("n") * 8) / BLOCK_BYTES)).cast("int").alias("parts"))
    full = full.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = cut(full.groupBy("key", "band", "part", "parts").agg(F.collect_list(F.struct("node", "comp", "n", "sig", "set")).alias("rows")), "minhash-blocks")
    left = blocks.select("key", "band", F.col("part").alias("p"), F.col("rows").alias("left"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("part"))
    pairs = left.join(blocks.select("key", "part", F.col("rows").alias("right")), ["key", "part"])
    return pairs.select("band", (F.col("p") == F.col("part")).alias("same"), "left", "right").mapInArrow(freed(_across), _PAIR)


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id column, n_shingles, component_id and kept for every row.

    Documents whose sets have 100 * intersection >= 80 * union are linked. Null and empty texts link
    with nothing. Rows of one id count as one document, whatever their texts. A null id gets a null
    component and is kept. Texts of any length give all their shingles; an empty table gives no rows;
    further columns are not read.
    """
    tune(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(docs.mapInArrow(freed(_features), "id long, n long, d1 long, d2 long, sig binary"), "minhash-rows")
    live = rows.filter("n > 0 and id is not null")
    nodes = cut(live.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "minhash-nodes")
    band = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda i: F.xxhash64(F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS)), i))
    bands = nodes.select("node", F.posexplode(band).alias("band", "key"))
    least = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").drop("last")
    members = cut(bands.join(least, "key").select("key", "band", "node", "pivot"), "minhash-members")
    sets = _sets(docs, members.select(F.col("node").alias("id")).distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        sig = nodes.select("node", "n", "sig")
        p = pairs.join(sig.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su")), "u")
        p = p.join(sig.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv")), "v")
        p = p.filter(100 * F.least("nu", "nv") >= 80 * F.greatest("nu", "nv")).select("u", "v", "su", "sv").mapInArrow(freed(_agree), _PAIR)
        p = cut(p, "minhash-agreed")
        p = p.join(sets.select(F.col("id").alias("u"), F.col("set").alias("xu")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("xv")), "v")
        return p.select("u", "v", "xu", "xv").mapInArrow(freed(_confirm), _PAIR)

    tested = cut(members.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), "minhash-pairs")
    links = cut(confirmed(tested), "minhash-links")
    at = members.join(components(links), "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("comp"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).filter("a < b").select("key", "size")
    at = cut(at.join(mixed, "key"), "minhash-mixed")
    few = at.filter(F.col("size") <= SMALL).select("key", "node", "comp")
    more = few.select("key", F.col("node").alias("x"), F.col("comp").alias("cx")).join(few, "key").filter("cx <> comp and x < node").select(F.col("x").alias("u"), F.col("node").alias("v"))
    more = more.distinct().join(tested, ["u", "v"], "left_anti")
    links = cut(links.union(confirmed(more)).union(_large_buckets(at.filter(F.col("size") > SMALL), nodes, sets)), "minhash-links")
    comp = components(links)
    node = live.select("id", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
    if rows.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty():
        label = node.join(comp, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    else:  # an id with several texts ties their nodes together
        ties = node.select(F.col("id").alias("u"), F.col("node").alias("v")).union(links)
        label = components(ties).select(F.col("node").alias("id"), "component").distinct()
    out = rows.select("id", "n").join(label, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count, component and verdict of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, and one row of it."""
    found = near_duplicates(docs)
    drop = cut(found.filter(~F.col("kept")).select("doc_id").distinct(), "minhash-dropped")
    out = docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not again.isEmpty():
        one = out.join(again, "doc_id", "left_semi").withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("__k = 1").drop("__k")
        out = out.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)
    return out


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM i WHERE 100 * common >= 80 * (nu + nv - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLES = {"op4_near_duplicates": _SQL}
