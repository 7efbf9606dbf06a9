"""Nearest neighbours by randomly rotated one-bit codes.

The index deals all rows to cells around centres (fitted on a bounded sample) and cells to blocks of
bounded size. A row's residual from its centre is normalised and rotated at random; the index keeps
its signs, packed into words, and correction scalars beside the vector. A query visits the cells of
largest expected scores, as many as the sample needs for the wanted recall: few where rows form clusters, most
where they have no order. In a block, its rotated components are rounded to a few bits, so that counts
of common bits of words estimate all inner products; the scalars bound the estimates' errors. Only rows
whose upper bound reaches the k-th best score known there are reranked by the original vectors, in double
precision. Every query visits its best cell first; what it finds there is what rows of its other cells must reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, freed, table, tune

#: Rows of a cell on average, and of a block at most (on average, where a cell is dealt out).
CELL = 4096
#: Cells at most: their centres travel to every task. Beyond it cells grow, and have more blocks.
MOST_CELLS = 65_536
#: Cells that a query visits at least, the share of neighbours in the sample that the visited cells must hold, and the queries that tell.
VISITS, RECALL, ASKED = 16, 0.95, 256
#: Rows that centres are fitted on, for each cell, and their bytes at most.
SAMPLE_EACH, SAMPLE_BYTES = 32, 64 << 20
#: Queries that are sent to a block together at most.
PACKET = 256
#: Signs of a code for each component of a vector, and bits of a query's component.
SPREAD, PLANES = 2, 5
#: Standard deviations (of the rotation's randomness) that the error bound covers.
SIGMAS = 4.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec of rows that take part: null, empty or zero vectors and those with null or non-finite components do not; nor null ids."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    return v.filter(F.col("id").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    """Random orthonormal columns: turn a vector of ``dim`` components, padded with zeros to SPREAD times as many."""
    wide = max(dim * SPREAD, 8)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, dim)))
    return (q * np.sign(np.diag(r))).T


@dataclass
class Cells:
    """Centres of the cells of one dimension, how far rows lie from them (root of the mean square), and how many a query visits."""

    centres: np.ndarray
    radius: np.ndarray
    most: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector."""
        with np.errstate(over="ignore", invalid="ignore"):  # vectors beyond all measure go to some cell
            half = (self.centres**2).sum(1) / 2
            return np.concatenate([np.nan_to_num(x[at : at + 1024] @ self.centres.T - half).argmax(1) for at in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)

    def hope(self, q: np.ndarray) -> np.ndarray:
        """What the best rows of each cell are expected to score."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(q @ self.centres.T + 3 * np.linalg.norm(q, axis=1)[:, None] * self.radius / q.shape[1] ** 0.5)

    def visits(self, q: np.ndarray) -> np.ndarray:
        """Cells that each query visits."""
        n = len(self.centres)
        if self.most >= n:
            return np.tile(np.arange(n), (len(q), 1))
        return np.argpartition(self.hope(q), n - self.most, axis=1)[:, n - self.most :]

    def calibrate(self, sample: np.ndarray, own: np.ndarray, k: int = 20) -> None:
        """Visit so many cells that they hold the wanted share of the nearest rows in the sample of some of its rows."""
        n = len(self.centres)
        if n <= VISITS:
            self.most = n
            return
        q = sample[:ASKED]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        top = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
        rank = np.empty((len(q), n), np.int64)
        np.put_along_axis(rank, np.argsort(-self.hope(q), axis=1), np.arange(n)[None, :], 1)
        need = np.sort(np.take_along_axis(rank, own[top], 1).reshape(-1))
        self.most = min(n, max(VISITS, int(need[int(np.ceil(RECALL * len(need))) - 1]) + 1))


def fit_cells(sample: np.ndarray, n: int, sweeps: int = 6, seed: int = 5) -> Cells:
    """Centres by Lloyd's sweeps over a sample; an empty cell keeps its centre."""
    sample = sample[np.random.default_rng(seed).permutation(len(sample))]
    cells = Cells(sample[:n].copy(), np.zeros(0), n)
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(sweeps):
            own = cells.of(sample)
            count = np.bincount(own, minlength=n)
            sums = np.zeros_like(cells.centres)
            np.add.at(sums, own, sample / np.maximum(count, 1)[own, None])
            cells.centres[count > 0] = sums[count > 0]
            if n == 1:
                break
        own = cells.of(sample)
        count = np.bincount(own, minlength=n)
        square = np.bincount(own, ((sample - cells.centres[own]) ** 2).sum(1), n)
        cells.radius = np.sqrt(np.where(count > 0, square / np.maximum(count, 1), square.sum() / max(1, len(sample))))
        cells.calibrate(sample, own)
    return cells


@dataclass
class Codes:
    """Words of packed signs, and for each row: its number of set signs, what turns a sum of signs into an inner product, and the error's deviation."""

    words: np.ndarray
    ones: np.ndarray
    scale: np.ndarray
    error: np.ndarray


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
    """Codes of vectors around their cell's centre."""
    r = x - centre
    top = np.abs(r).max(axis=1, initial=0)
    norm = np.where(top > 0, top * np.linalg.norm(r / np.where(top > 0, top, 1)[:, None], axis=1), 0.0)
    wide = turn.shape[1]
    y = (r / np.where(norm > 0, norm, 1)[:, None]) @ turn
    bits = np.zeros((len(x), -(-wide // 64) * 64), bool)
    bits[:, :wide] = y > 0
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    along = np.maximum(np.abs(y).sum(1) / np.sqrt(wide), 1e-6)  # cosine of the vector and its code
    return Codes(words, np.bitwise_count(words).sum(1).astype(np.float64), norm / along / np.sqrt(wide), norm * np.sqrt(np.maximum(0, 1 - along**2)) / along / np.sqrt(wide - 1))


def search_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, codes: Codes, centre: np.ndarray, k: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and ids and exact scores of its k best rows of the block that reach its known score, if it has one.

    Without a known score, the k rows of largest estimate are scored first; the least of their scores is what a row's upper
    bound must reach to be scored as well.
    """
    turned, base = q @ rotation(x.shape[1]), q @ centre
    wide = turned.shape[1]
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), np.finfo(float).tiny)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    rounded = low[:, None] + step[:, None] * level
    lost = np.linalg.norm(turned - rounded, axis=1)
    planes = np.zeros((len(q), PLANES, codes.words.shape[1] * 64), bool)
    planes[:, :, :wide] = level[:, None, :] >> np.arange(PLANES)[None, :, None] & 1
    planes = np.packbits(planes, axis=2, bitorder="little").view("<u8")
    size = np.linalg.norm(q, axis=1)
    words = np.ascontiguousarray(codes.words.T)  # word by word: rows lie together
    for i in range(len(q)):
        common = np.zeros(len(vid), np.int32)
        for p in range(PLANES):
            for w, plane in zip(words, planes[i, p]):
                if plane:
                    common += np.bitwise_count(w & plane).astype(np.int32) << p
        est = codes.scale * (2 * (low[i] * codes.ones + step[i] * common) - rounded[i].sum())
        out = vid == qid[i]
        least = -np.inf if known is None else known[i]
        if least == -np.inf and len(vid) > k:
            est[out] = -np.inf
            first = np.argpartition(est, len(est) - k)[len(est) - k :]
            least = np.where(out[first], -np.inf, (x[first] * q[i]).sum(1)).min()
        bound = np.sqrt((size[i] * codes.error) ** 2 + (codes.scale * lost[i]) ** 2) * SIGMAS if least > -np.inf else np.inf
        pick = np.flatnonzero((est + bound + base[i] >= least - 1e-9 * (1 + abs(least)) if least > -np.inf else True) & ~out)
        score = (x[pick] * q[i]).sum(1)
        if known is not None:
            pick, score = pick[score >= known[i]], score[score >= known[i]]
        best = np.lexsort((vid[pick], -score))[:k]
        yield i, vid[pick][best], score[best]


def _matrix(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, rows and vectors of each dimension in a column of vectors."""
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    start = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        mine = np.flatnonzero(size == dim)
        yield dim, mine, flat[start[mine][:, None] + np.arange(dim)]


def fit(live: DataFrame) -> dict[int, Cells]:
    """Cells of each dimension, fitted on a sample bounded by SAMPLE_EACH rows a cell and SAMPLE_BYTES, chosen by a hash of the id."""
    dims = {r["dim"]: r["n"] for r in live.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in sorted(dims.items()):
        cells = min(MOST_CELLS, max(1, n // CELL))
        most = max(16, min(SAMPLE_EACH * cells + 4096, SAMPLE_BYTES // (8 * dim)))
        u = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
        some = live.filter((F.size("vec") == dim) & (u < int(min(1.0, 1.2 * most / n) * (1 << 30)))).select("id", "vec").toArrow()
        order = np.argsort(some.column("id").to_numpy(), kind="stable")[:most]
        vec = some.column("vec").combine_chunks()
        x = vec.flatten().to_numpy().reshape(-1, dim)[order] if len(vec) else np.zeros((1, dim))
        out[dim] = fit_cells(x, min(cells, len(x)))
    return out


def index(live: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Blocks of all rows: dim, cell, part, and packed ids, vectors, words and scalars; written once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            for dim, mine, x in _matrix(b.column(1)):
                cell[mine] = cells[dim].of(x)
            yield pa.RecordBatch.from_arrays([*b.columns, b.column(1).value_lengths(), pa.array(cell)], names=["id", "vec", "dim", "cell"])

    dealt = cut(live.mapInArrow(freed(deal), "id long, vec array<double>, dim int, cell long"), "ann-cells")
    parts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / CELL).cast("long").alias("parts"))  # at most one row for each centre
    rows = dealt.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")))
    rows = rows.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part").select("id", "vec", "dim", "cell", "part")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key: tuple[int, int, int] | None = None

        def flush() -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held))
            c = encode(x, cells[key[0]].centres[key[1]], rotation(key[0]))
            raw = [ids.tobytes(), x.tobytes(), c.words.tobytes(), np.stack([c.ones, c.scale, c.error]).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([key[2]]), *(pa.array([r], pa.binary()) for r in raw)], names=["dim", "cell", "part", "ids", "vectors", "words", "scalars"])

        for b in batches:
            ids, dim, cell, part = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
            size, flat = b.column(1).value_lengths().to_numpy(), b.column(1).flatten().to_numpy()
            ends = np.cumsum(size)
            cuts = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), True]) if len(ids) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                now = (int(dim[lo]), int(cell[lo]), int(part[lo]))
                if held and (now != key or sum(len(i) for i, _ in held) >= CELL):
                    yield flush()
                    held = []
                key = now
                held.append((ids[lo:hi], flat[ends[lo] - size[lo] : ends[hi - 1]].reshape(-1, now[0])))
        if held:
            yield flush()

    return cut(rows.mapInArrow(freed(pack), "dim int, cell long, part long, ids binary, vectors binary, words binary, scalars binary"), "ann-index")


def packets(asked: DataFrame, cells: dict[int, Cells], first: bool) -> DataFrame:
    """Queries (id, mark, known, vec) by their best cell, or by the others that they visit: dim, cell, and packed columns of up to PACKET queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(3)]
            for dim, mine, x in _matrix(b.column(3)):
                if dim not in cells:
                    continue
                best = cells[dim].hope(x).argmax(1)
                to = best[:, None] if first else cells[dim].visits(x)
                own, cell = np.repeat(np.arange(len(x)), to.shape[1]), to.reshape(-1)
                if not first:
                    own, cell = own[cell != best[own]], cell[cell != best[own]]
                order = np.argsort(cell, kind="stable")
                own, cell = own[order], cell[order]
                cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]) if len(cell) else np.zeros(1, int)
                rows = []
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    for at in range(lo, hi, PACKET):
                        some = own[at : min(hi, at + PACKET)]
                        rows.append((dim, int(cell[lo]), *(c[mine[some]].tobytes() for c in columns), x[some].tobytes()))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), kinds)], names=["dim", "cell", "q_ids", "q_marks", "q_known", "q_vectors"])

    return asked.select("id", "mark", "known", "vec").mapInArrow(freed(run), "dim int, cell long, q_ids binary, q_marks binary, q_known binary, q_vectors binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` rows of largest inner product among those of the cells that it visits.

    Ties go to the smaller id; a query's own id is no candidate; a query meets only vectors of its
    own dimension and gets all of them if there are fewer than ``k``. See ``usable`` for rows that
    take no part. Repeated ids are separate rows, and repeated query ids with different vectors share their ranks' numbers but
    not their rows. Of equal vectors, only the ``k`` + 1 of least ids can ever be among the nearest, and only those are indexed.
    Other columns take no part, whatever their names. No vectors or no queries: no rows.
    """
    tune(vectors.sparkSession)
    live = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).withColumn("mark", F.xxhash64("vec")).dropDuplicates(["id", "mark"])
    same = Window.partitionBy(F.xxhash64("vec"), F.hash("vec"), F.size("vec")).orderBy("id")
    live = cut(live.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("id", "vec"), "ann-vectors")
    cells = fit(live)
    blocks = index(live, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_marks, q_known, q_vectors, dim, cell, ids, vectors_, words, scalars in zip(*(b.column(i).to_pylist() for i in range(10))):
                qid, mark, known, vid = np.frombuffer(q_ids, np.int64), np.frombuffer(q_marks, np.int64), np.frombuffer(q_known), np.frombuffer(ids, np.int64)
                x, q = np.frombuffer(vectors_).reshape(-1, dim), np.frombuffer(q_vectors).reshape(-1, dim)
                codes = Codes(np.frombuffer(words, "<u8").reshape(len(vid), -1), *np.frombuffer(scalars).reshape(3, -1))
                got = list(search_block(qid, q, vid, x, codes, cells[dim].centres[cell], k, known))
                n = [len(g[1]) for g in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(np.repeat(mark, n)), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], names=["query_id", "mark", "vec_id", "score"])

    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")

    def visited(queries_: DataFrame, first: bool) -> DataFrame:
        pairs = packets(queries_, cells, first).join(blocks, ["dim", "cell"])
        return pairs.select("q_ids", "q_marks", "q_known", "q_vectors", "dim", "cell", "ids", "vectors", "words", "scalars").mapInArrow(freed(run), "query_id long, mark long, vec_id long, score double")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    begun = cut(ranked(visited(asked.withColumn("known", none), True)), "ann-first")
    least = begun.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "mark", F.col("score").alias("known"))
    rest = visited(asked.join(least, ["id", "mark"], "left").withColumn("known", F.coalesce("known", none)), False)
    return ranked(begun.drop("rank").union(rest)).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every vector whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings")
    return nearest(v, v.filter(F.col("vec_id") % 20 == 0), 20)


_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op7_nearest": op7_nearest}
ORACLES = {"op7_nearest": _SQL}
