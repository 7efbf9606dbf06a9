"""Language-model scores from Brown classes.

Exchange clustering assigns words to classes. The most frequent words and the groups of all others by
their last characters are exchanged first, on one matrix. Then every other word that occurs a few times leaves
its group: a distributed sweep gathers how often each class stands before and behind it, and gives it the
class of largest exchange gain. Groups remain for rarer words and those never seen. Classes grow with the cube root of
the vocabulary. A text's probability is the product of smoothed class transitions and word emissions,
whose counts come from all training documents under the final classes.

Counts and classes of the most frequent words travel to every task; those of all other words are joined
by a shuffle, once for each batch of texts that holds them, so no key is hot and no word is dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bitmap, bits_for, cut, fold, freed, table, tune

#: Words that are exchanged on one matrix, groups of the others there, classes at least, and words whose counts and classes are sent to every task.
SINGLE, GROUPS, CLASSES, HEAD = 1024, 256, 64, 200_000
#: A word leaves its group if it occurs so often: the neighbours of rarer ones tell too little.
LEAST = 5
#: Tokens whose neighbours are counted at once, and bytes of texts whose words are joined together.
TOKENS, TEXT_BYTES = 2_000_000, 8 << 20
SUFFIX = 3
END = b""  # one at the end of each text; no word is empty
_FLUSH = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, lower-cased in A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def group_of(word: bytes) -> int:
    return crc32(word[-SUFFIX:]) % GROUPS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for x in b.column(0).to_pylist():
            held.update(words_of(x))
            held[END] += 1
            if len(held) > _FLUSH:
                yield flush()
                held = Counter()
    if held:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n for every token of the text column; END counts the texts."""
    parts = texts.mapInArrow(freed(_count), "word binary, n long")
    return cut(parts.groupBy("word").agg(F.sum("n").alias("n")), "brown-words")


class Units(dict):
    """Unit of a word: 0 for END, its own for a single word, and its group's for all others."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + group_of(word)


def neighbours(texts: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each, over all texts, END before and behind each: a matrix of fixed size."""
    size = len(units) + GROUPS

    class Found(dict):
        """Units of the words met so far."""

        def __missing__(self, word: bytes) -> int:
            if len(self) >= TOKENS:
                self.clear()
            self[word] = at = units[word]
            return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(size * size, np.int64), Found()
        for b in batches:
            held, n = [], 0
            for x in b.column(0).to_pylist():
                w = words_of(x)
                u = np.zeros(len(w) + 2, np.int64)
                u[1:-1] = np.fromiter(map(found.__getitem__, w), np.int64, len(w))
                held.append(u[:-1] * size + u[1:])
                n += len(u)
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=size * size)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=size * size)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(total[at[k : k + 100_000]])], names=["pair", "n"])

    got = texts.mapInArrow(freed(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = 6) -> np.ndarray:
    """Class of each unit: moves one unit after another to the class that gains most likelihood, until none moves.

    Unit 0 (END) has class 0 for itself.
    """
    size = len(n)
    classes = max(2, min(classes, size))
    into, out = n.sum(0), n.sum(1)
    order = 1 + np.argsort(-(into + out)[1:], kind="stable")
    cls = np.zeros(size, np.int64)
    cls[order] = 1 + np.arange(size - 1) % (classes - 1)
    one = np.eye(classes)[cls]
    b = one.T @ n @ one
    left, right = b.sum(1), b.sum(0)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, s = cls[u], n[u, u]
            if into[u] + out[u] == 0:
                continue
            lu = np.bincount(cls, n[:, u], classes)
            ru = np.bincount(cls, n[u], classes)
            lu[a] -= s
            ru[a] -= s
            b[:, a] -= lu
            b[a] -= ru
            b[a, a] -= s
            left[a] -= out[u]
            right[a] -= into[u]
            fb = _xlogx(b)
            gain = (_xlogx(b + lu[:, None]) - fb).sum(0) + (_xlogx(b + ru[None, :]) - fb).sum(1)
            d = np.diagonal(b)
            gain += _xlogx(d + lu + ru + s) + _xlogx(d) - _xlogx(d + lu) - _xlogx(d + ru)
            gain -= _xlogx(left + out[u]) - _xlogx(left) + _xlogx(right + into[u]) - _xlogx(right)
            gain[0] = -np.inf
            to = int(gain.argmax())
            if gain[to] <= gain[a] + 1e-9:
                to = a
            moved += to != a
            cls[u] = to
            b[:, to] += lu
            b[to] += ru
            b[to, to] += s
            left[to] += out[u]
            right[to] += into[u]
        if not moved:
            break
    return cls


def classes_for(distinct: int) -> int:
    return max(CLASSES, round(distinct ** (1 / 3)))


def _sided(units: Units, cls: np.ndarray, size: int, often: np.ndarray, bits: int):
    """A function of batches: words beyond the single ones with codes (class before, or ``size`` more and class behind) and their counts.

    Words without a bit in ``often`` are left out.
    """

    n_units = len(units) + GROUPS

    class Ids(dict):
        """Unit of a word, and n_units times its number from 1 in the order in which they come; 0 for those left out."""

        def __init__(self) -> None:
            self.words: list[bytes] = []

        def __missing__(self, word: bytes) -> int:
            out = units[word]
            at = crc32(word) & ((1 << bits) - 1)
            if out >= len(units) and often[at >> 3] >> (at & 7) & 1:
                self.words.append(word)
                out += n_units * len(self.words)
            self[word] = out
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, codes, n = Ids(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            ends = np.searchsorted(code // (2 * size), np.arange(len(at.words) + 1))
            entry = np.zeros(len(code), _ENTRY)
            entry["code"], entry["n"] = code % (2 * size), count
            raw = entry.tobytes()
            ends = ends * _ENTRY.itemsize
            for k in range(0, len(at.words), 50_000):
                part = ends[k : k + 50_001]
                data = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer((part - part[0]).astype(np.int32)), pa.py_buffer(raw[part[0] : part[-1]])])
                yield pa.RecordBatch.from_arrays([pa.array(at.words[k : k + 50_000], pa.binary()), data], names=["word", "entries"])

        for b in batches:
            for x in b.column(0).to_pylist():
                w = words_of(x)
                ids = np.fromiter(map(at.__getitem__, w), np.int64, len(w))
                mine = np.flatnonzero(ids >= n_units)
                if len(mine):
                    u = np.zeros(len(w) + 2, np.int64)
                    u[1:-1] = ids % n_units
                    k, ids = cls[u], (ids[mine] // n_units - 1) * (2 * size)
                    codes += [ids + k[mine], ids + size + k[mine + 2]]
                    n += len(mine)
                if n >= TOKENS or len(at) >= TOKENS:
                    if n:
                        yield from flush()
                    at, codes, n = Ids(), [], 0
        if n:
            yield from flush()

    return run


_ENTRY = np.dtype([("code", "<u2"), ("n", "<u4")])


def best_classes(codes: list[np.ndarray], counts: list[np.ndarray], old: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each word (each has neighbours) the class of largest exchange gain, by its neighbours' classes; b holds all transitions, the word's own at its old class."""
    size = len(b)
    word = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    code, n = np.concatenate(codes), np.concatenate(counts).astype(float)
    near = np.vstack([b, b.T])  # transitions between a neighbour's class and each class
    gain = _xlogx(near[code] + n[:, None]) - _xlogx(near)[code]
    home, at = old[word], np.arange(len(code))
    rest = np.maximum(near[code, home] - n, 0)  # its own transitions leave its old class first
    gain[at, home] = _xlogx(rest + n) - _xlogx(rest)
    gain = np.add.reduceat(gain, np.r_[0, np.cumsum([len(c) for c in codes])[:-1]])
    total = np.bincount(word, np.where(code < size, n, 0), len(codes))[:, None]
    home = np.arange(size)[None, :] == old[:, None]
    for whole in (b.sum(1)[None, :], b.sum(0)[None, :]):
        rest = np.maximum(whole - home * total, 0)
        gain -= _xlogx(rest + total) - _xlogx(rest)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def _assigned(groups: np.ndarray, b: np.ndarray):
    """A function of batches of words in order, with codes and counts: each word once, with its count and class."""
    size = len(b)

    def out(words: list[bytes], word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Words, and the number of the word, code and count of each entry, in the order of words."""
        total = np.bincount(word, np.where(code < size, n, 0), len(words)).astype(np.int64)
        cls = groups[[group_of(w) for w in words]]
        pair, at = np.unique(word * (2 * size) + code, return_inverse=True)
        n = np.bincount(at.reshape(-1), n)
        word, code = pair // (2 * size), pair % (2 * size)
        often = np.flatnonzero(total >= LEAST)
        ends = np.searchsorted(word, np.arange(len(words) + 1))
        for at in range(0, len(often), 500):
            some = often[at : at + 500].tolist()
            cls[some] = best_classes([code[ends[i] : ends[i + 1]] for i in some], [n[ends[i] : ends[i + 1]] for i in some], cls[some], b)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(total), pa.array(cls.astype(np.int32))], names=["word", "n", "cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray, np.ndarray] | None = None  # its rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            size_ = np.array([len(x) for x in data]) // _ENTRY.itemsize
            entry = np.frombuffer(b"".join(data), _ENTRY)
            code, n = entry["code"].astype(np.int64), entry["n"].astype(np.int64)
            if last is not None:
                rows, size_ = [last[0], *rows], np.r_[len(last[1]), size_]
                code, n = np.r_[last[1], code], np.r_[last[2], n]
            new = np.r_[True, [x != y for x, y in zip(rows[1:], rows)]].astype(bool)
            word = np.repeat(np.cumsum(new) - 1, size_)
            words = [rows[i] for i in np.flatnonzero(new).tolist()]
            done = word < len(words) - 1
            if len(words) > 1:
                yield out(words[:-1], word[done], code[done].astype(np.int64), n[done])
            codes, at = np.unique(code[~done], return_inverse=True)
            last = (words[-1], codes, np.bincount(at.reshape(-1), n[~done]).astype(np.int64))
        if last is not None:
            yield out([last[0]], np.zeros(len(last[1]), np.int64), last[1].astype(np.int64), last[2])

    return run


@dataclass
class Classes:
    """Classes of words: of the most frequent ones in ``head``, of groups for words never seen, and of all in ``words`` (word, n, cls)."""

    head: list[bytes]
    counts: np.ndarray
    of_head: np.ndarray
    of_group: np.ndarray
    size: int
    words: DataFrame
    tokens: int
    distinct: int
    ends: int  # training texts


@dataclass
class ClassModel:
    """Classes, and log tables of their transitions and emissions."""

    classes: Classes
    step: np.ndarray  # log10 of the transition from class to class
    below: np.ndarray  # log10 of the divisor of a class's emissions

    @property
    def tokens(self) -> int:
        return self.classes.tokens


def cluster(texts: DataFrame, counts: DataFrame) -> Classes:
    """Classes of all words. texts: one text column of the training rows; counts: their ``word_counts``."""
    spark = texts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0)).alias("e")).first()
    top = counts.filter(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(SINGLE).toArrow()
    single, n = top.column("word").to_pylist(), top.column("n").to_pylist()
    units = Units({END: 0} | {w: i + 1 for i, w in enumerate(single)})
    follow = neighbours(texts, units)
    cls = exchange(follow, classes_for(total["v"]))
    size = int(cls.max()) + 1
    b = np.zeros((size, size))
    np.add.at(b, (cls[:, None].repeat(len(cls), 1), cls[None, :].repeat(len(cls), 0)), follow)
    groups = cls[len(units) :]
    plain = counts.filter(F.octet_length("word") > 0)
    common = plain.filter(F.col("n") >= LEAST)
    bits = bits_for(common.count())
    often = bitmap(common.select((F.crc32("word") % (1 << bits)).cast("long").alias("p")), bits)
    sided = texts.mapInArrow(freed(_sided(units, cls, size, often, bits)), "word binary, entries binary")
    moved = sided.repartition("word").sortWithinPartitions("word").mapInArrow(freed(_assigned(groups, b)), "word binary, n long, cls int").filter(F.col("n") >= LEAST)
    # Rarer words stay with their groups; single ones have their own classes, however rare.
    suffix = F.when(F.octet_length("word") > SUFFIX, F.substring("word", -SUFFIX, SUFFIX)).otherwise(F.col("word"))
    group = F.get(F.array(*[F.lit(int(g)) for g in groups]), (F.crc32(suffix) % GROUPS).cast("int"))
    first = spark.createDataFrame([(bytearray(w), k, int(cls[i + 1])) for i, (w, k) in enumerate(zip(single, n))], "word binary, n long, cls int")
    rare = plain.filter(F.col("n") < LEAST).join(F.broadcast(first.select("word")), "word", "left_anti").select("word", "n", group.cast("int").alias("cls"))
    words = cut(moved.unionByName(rare).unionByName(first), "brown-classes")
    top = words.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    return Classes(top.column("word").to_pylist(), top.column("n").to_numpy(), top.column("cls").to_numpy().astype(np.int64), groups, size, words, total["n"], total["v"], total["e"])


def _skeletons(c: Classes, id_type: pa.DataType):
    """A function of batches (id, text): one row for some MB of texts, with the class of each token or, below zero, its place among the words to be joined."""
    at = {w: i for i, w in enumerate(c.head)}
    of_head, log_n, log_end, known_end = c.of_head, np.log10(c.counts + 0.5), float(np.log10(c.ends + 0.5)), int(c.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, known, num, seqs, rest, n, size = [], [], [], [], [], {}, 0, 0

        def flush() -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, id_type), (ends, pa.int64()), (known, pa.int64()), (num, pa.float64()), (list(rest), pa.binary()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([np.concatenate(seqs).astype(np.int32).tobytes()], pa.binary())], names=["ids", "ends", "known", "num", "words", "seq"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(x)
                p = np.fromiter((at.get(t, -1) for t in w), np.int64, len(w))
                seen = p >= 0
                k = np.zeros(len(w), np.int64)
                k[seen] = of_head[p[seen]]
                far = np.flatnonzero(~seen)
                k[far] = np.fromiter((-1 - rest.setdefault(w[j], len(rest)) for j in far.tolist()), np.int64, len(far))
                n += len(w)
                ids.append(i)
                ends.append(n)
                known.append(int(seen.sum()) + known_end)
                num.append(float(log_n[p[seen]].sum()) + log_end)
                seqs.append(k)
                size += len(x or "")
            if size >= TEXT_BYTES:
                yield flush()
                ids, ends, known, num, seqs, rest, n, size = [], [], [], [], [], {}, 0, 0
        if ids:
            yield flush()

    return run


def _filled(groups: np.ndarray):
    """A function of batches of skeletons and their joined words: a row for each text, with its counts and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, ends, known, num, words, seq, got = (b.column(i)[r] for i in range(7))
                seq, ends = np.frombuffer(seq.as_py(), np.int32).astype(np.int64), ends.values.to_numpy()
                words = words.as_py()
                cls = groups[[group_of(w) for w in words]] if words else np.zeros(0, np.int64)
                n = np.zeros(len(words))
                if got.is_valid and len(got.values):
                    j = got.values.field("j").to_numpy()
                    cls, n[j] = cls.copy(), got.values.field("n").to_numpy()
                    cls[j] = got.values.field("cls").to_numpy()
                far = np.flatnonzero(seq < 0)
                place = -1 - seq[far]
                own = np.searchsorted(ends, far, side="right")
                more_known = np.bincount(own, n[place] > 0, len(ends)).astype(np.int64)
                more_num = np.bincount(own, np.log10(n[place] + 0.5), len(ends))
                seq = seq.copy()
                seq[far] = cls[place]
                start = np.r_[0, ends[:-1]]
                packed = seq.astype(np.uint16)
                for at in range(0, len(ends), 1000):
                    rows = range(at, min(at + 1000, len(ends)))
                    s = slice(at, at + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [ids.values[at : at + 1000], pa.array(ends[s] - start[s] + 1), pa.array(known.values.to_numpy()[s] + more_known[s]), pa.array(num.values.to_numpy()[s] + more_num[s]), pa.array([packed[start[i] : ends[i]].tobytes() for i in rows], pa.binary())],
                        names=["id", "n_tokens", "n_known", "num", "seq"],
                    )

    return run


def sequences(df: DataFrame, c: Classes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, num (sum of log10(count + 0.5) over tokens) and seq (classes of the words, packed) of every row.

    Texts are read by one job whose result is written; so no later task depends on how rows met in batches.
    """
    tune(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = rows.limit(0).toArrow().schema.field("id").type
    parts = cut(rows.mapInArrow(freed(_skeletons(c, id_type)), f"ids array<{kind}>, ends array<long>, known array<long>, num array<double>, words array<binary>, seq binary").withColumn("key", F.xxhash64("ids", F.md5("seq"), F.monotonically_increasing_id())), "brown-parts")
    far = parts.select("key", F.posexplode("words").alias("j", "word")).join(c.words, "word").groupBy("key").agg(F.collect_list(F.struct("j", "n", "cls")).alias("got"))
    out = parts.join(far, "key", "left").select("ids", "ends", "known", "num", "words", "seq", "got")
    return cut(out.mapInArrow(freed(_filled(c.of_group)), f"id {kind}, n_tokens long, n_known long, num double, seq binary"), "brown-sequences")


def transitions(seqs: DataFrame, c: Classes) -> ClassModel:
    """The model whose counts are those of all sequences: class after class, END before and behind each."""
    size = c.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                k = np.zeros(len(x) // 2 + 2, np.int64)
                k[1:-1] = np.frombuffer(x, np.uint16)
                total += np.bincount(k[:-1] * size + k[1:], minlength=size * size) if len(k) > size * size else 0
                if len(k) <= size * size:
                    np.add.at(total, k[:-1] * size + k[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    got = seqs.select("seq").mapInArrow(freed(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    b = np.zeros(size * size)
    b[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    b = b.reshape(size, size)
    share = (b.sum(0) + 0.5) / (b.sum() + 0.5 * size)
    step = np.log10((b + share[None, :]) / (b.sum(1)[:, None] + 1))
    kinds = np.zeros(size)  # distinct words of each class
    kinds[0] = 1
    for r in c.words.groupBy("cls").count().collect():
        kinds[r["cls"]] += r["count"]
    return ClassModel(c, step, np.log10(b.sum(0) + 0.5 * (kinds + 1)))


def fit(texts: DataFrame, counts: DataFrame) -> ClassModel:
    """Cluster and count. texts: one text column of the training rows; counts: their ``word_counts``."""
    tune(texts.sparkSession)
    c = cluster(texts, counts)
    return transitions(sequences(texts.select(F.lit(0).alias("id"), F.col(texts.columns[0]).alias("text")), c, "text", "id"), c)


def scored(seqs: DataFrame, model: ClassModel, id_col: str = "doc_id") -> DataFrame:
    """id column, n_tokens, n_known, base_score and score of sequences."""
    step, below = model.step, model.below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = []
            for x in b.column(4).to_pylist():
                k = np.zeros(len(x) // 2 + 2, np.int64)
                k[1:-1] = np.frombuffer(x, np.uint16)
                rest.append(float(step[k[:-1], k[1:]].sum() - below[k[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rest, pa.float64())], names=["id", "n_tokens", "n_known", "num", "rest"])

    kind = seqs.schema["id"].dataType.simpleString()
    out = seqs.select("id", "n_tokens", "n_known", "num", "seq").mapInArrow(freed(run), f"id {kind}, n_tokens long, n_known long, num double, rest double")
    d = float(np.log10(model.classes.tokens + 0.5 * (model.classes.distinct + 1)))
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", (F.col("num") - F.col("n_tokens") * d).alias("base_score"), (F.col("num") + F.col("rest")).alias("score"))


def score(df: DataFrame, model: ClassModel, counts: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, base_score and score (log10 probabilities) for every row; the model holds all counts.

    A null text is an empty one: its END is its only token. Texts of any length are scored whole. Rows that
    repeat an id, or are equal, are scored each; a null id stays null. Words of equal counts are taken in the
    order of their bytes. Other columns take no part, whatever their names. Without training rows every token is
    unknown; an empty table gives no rows.
    """
    return scored(sequences(df, model.classes, text_col, id_col), model, id_col)


def op3_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-model scores of every document, learned outside the held-out fifth."""
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.filter(fold("doc_id", 5) != 1).select("text")
    classes = cluster(train, word_counts(train))
    seqs = sequences(docs, classes)
    model = transitions(seqs.filter(fold("id", 5) != 1), classes)
    out = scored(seqs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op3_class_scores": op3_class_scores}
ORACLES: dict[str, str] = {}
