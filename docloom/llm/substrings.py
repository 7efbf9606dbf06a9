"""Exact substring dedup: bounded interval expansion on a Burrows-Wheeler transform.

All 100-byte windows of all texts are compared. Windows are dealt out by content: each belongs to the
smallest 24-byte gram inside it (by a hash, leftmost of equals), so equal windows meet. Neighbouring
windows of one gram make a segment. Segments that are equal as a whole need no comparison: all but
the earliest are repeats. The distinct segments of a gram are compared through a Burrows-Wheeler
transform of their 8-byte symbols, which are aligned to the gram: breadth-first backward extension
derives common prefixes by increasing length and stops at 11 symbols, the most that every window
holds whole. The bytes at the edges of a window decide the rest. A gram in so many contexts that one
task should not hold them all gives its windows, one by one, to the exchange that finds equal
segments: exact as well, and without bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, freed, table, tune

LENGTH, GRAM, SYMBOL = 100, 24, 8
SPAN = LENGTH - GRAM + 1  # grams of a window
DEPTH = (LENGTH - SYMBOL + 1) // SYMBOL  # whole symbols of every window
OFFSET_BITS = 29  # a text has fewer than 2^29 bytes
CHUNK = 1 << 19
FLUSH = 1 << 20
BLOCK = 3 << 19
#: Distinct segments of a gram that one task compares at most (about 7 MB).
MOST_CONTEXTS = 50_000
_REPEAT = 127
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)


def _power(e: int) -> np.uint64:
    return _U(pow(_P, e, 1 << 64))


_POWERS = None


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS is None or len(_POWERS) < n:
        _POWERS = np.cumprod(np.r_[_U(1), np.full(max(n, 2 * CHUNK) + LENGTH, _U(_P))], dtype=_U)
    return _POWERS


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the gram at every place, by doubling."""
    h, n = _BYTE[b], 1
    while n < 8:
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
    m = len(b) - GRAM + 1
    h = (h[:m] * _power(8) + h[8 : 8 + m]) * _power(8) + h[16 : 16 + m]
    h ^= h >> _U(31)
    h *= _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """Place of the least gram of every window: the place is in the low bits, so the leftmost of equals is least."""
    m = (h & ~_U(0xFFFFF)) | np.arange(len(h), dtype=_U)
    n = 1
    while 2 * n <= SPAN:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    m = np.minimum(m[: len(m) - (SPAN - n)], m[SPAN - n :])
    return (m & _U(0xFFFFF)).astype(np.int64)


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of pieces of text that hold fewer than 2^20 bytes together: piece, start, windows, gram's offset, gram hash and content hash of every segment."""
    size = np.array([len(x) for x in texts])
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    if len(b) < LENGTH:
        return none
    h = _grams(b)
    place = _least(h)
    piece = np.repeat(np.arange(len(texts)), size)
    w = np.flatnonzero(piece[: len(place)] == piece[LENGTH - 1 : LENGTH - 1 + len(place)])
    if not len(w):
        return none
    p, d = place[w], piece[w]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
    a, end = w[new], np.r_[w[new[1:] - 1], w[-1]] + 1
    power = _powers(len(b))
    total = np.r_[_U(0), np.cumsum(_BYTE[b] * power[len(b) - 1 :: -1][: len(b)], dtype=_U)]
    rel = p[new] - a
    content = (total[end + LENGTH - 1] - total[a]) * power[a]
    content = (content ^ (content >> _U(32))) * _U(_P) + rel.astype(_U)
    start = a - (np.cumsum(size) - size)[d[new]]
    return d[new], start, end - a, rel, h[p[new]], content


def _pieces(ords: list[int], texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of pieces of at most CHUNK bytes or so: order numbers, offsets and bytes; long texts are cut with an overlap that keeps windows whole."""
    o, f, t, n = [], [], [], 0
    for i, x in zip(ords, texts):
        raw = (x or "").encode("utf-8", "surrogatepass")
        if len(raw) >= 1 << OFFSET_BITS:
            raise ValueError(f"a text has {len(raw)} bytes; fewer than 2^{OFFSET_BITS} are allowed")
        for at in range(0, len(raw) - LENGTH + 1, CHUNK):
            piece = raw[at : at + CHUNK + LENGTH - 1]
            if n and n + len(piece) > CHUNK:
                yield o, f, t
                o, f, t, n = [], [], [], 0
            o.append(i)
            f.append(at)
            t.append(piece)
            n += len(piece)
    if t:
        yield o, f, t


def _firsts(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of (gram, content, place, shape) as code, content and place; all but the first of equal ones are marked and spread."""
    gram, content, place, shape = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((place, content, gram))
    gram, content, place, shape = gram[order], content[order], place[order], shape[order]
    again = np.r_[False, (gram[1:] == gram[:-1]) & (content[1:] == content[:-1])]
    spread = (place.astype(_U) * _U(_P)) >> _U(14)
    gram = np.where(again, spread, gram)
    shape = np.where(again, shape | _REPEAT, shape)
    code = (gram << _U(14)) | shape.astype(_U)
    content = np.where(again, _U(0), content)
    for k in range(0, len(code), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (code.view(np.int64), content.view(np.int64), place)], names=["code", "content", "place"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram (50 bits of its hash, then windows and offset), content and place of segments; of equal ones in reach only the first, the others marked as repeats."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for b in batches:
        for ords, offsets, texts in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
            d, start, windows, rel, gram, content = segments(texts)
            place = (np.array(ords, np.int64)[d] << OFFSET_BITS) | (start + np.array(offsets)[d])
            held.append((gram >> _U(14), content, place, (windows << 7) | rel))
            n += len(d)
            if n >= FLUSH:
                yield from _firsts(held)
                held, n = [], 0
    if n:
        yield from _firsts(held)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of segments (gram, place, shape, data) as a segment of its own, named by a hash of its bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for b in batches:
        for place, shape, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            m = shape >> 7
            h = [xxhash.xxh3_128_digest(data[w : w + LENGTH]) for w in range(m)]
            h = np.frombuffer(b"".join(h), _U).reshape(-1, 2)
            held.append((h[:, 0] >> _U(14), h[:, 1].copy(), place + np.arange(m), np.full(m, 1 << 7)))
            n += m
            if n >= FLUSH:
                yield from _firsts(held)
                held, n = [], 0
    if n:
        yield from _firsts(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From occurrences in the order of gram, content and place: those to remove, and the first of each content of grams with several contents.

    The last content seen waits for the next batch, as its gram may have another one there.
    """
    wait: tuple[int, int, int, int, bool] | None = None  # gram, content, place, shape, whether asked for already

    def out(place, shape, gram, ask) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(shape.astype(np.int32)), pa.array(gram), pa.array(ask)], names=["place", "shape", "gram", "ask"])

    for b in batches:
        code, content, place = (b.column(i).to_numpy() for i in range(3))
        if not len(code):
            continue
        gram, shape = (code.view(_U) >> _U(14)).astype(np.int64), code & 16383
        plain = (shape & 127) != _REPEAT
        done = ~plain
        yield out(place[done], shape[done], gram[done], np.zeros(done.sum(), bool))
        gram, content, place, shape = gram[plain], content[plain], place[plain], shape[plain]
        if not len(gram):
            continue
        if wait:
            gram, content, place, shape = np.r_[wait[0], gram], np.r_[wait[1], content], np.r_[wait[2], place], np.r_[wait[3], shape]
        first = np.r_[True, (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])]
        yield out(place[~first], shape[~first], gram[~first], np.zeros((~first).sum(), bool))
        gram, content, place, shape = gram[first], content[first], place[first], shape[first]
        same = gram[1:] == gram[:-1]
        ask = np.r_[False, same] | np.r_[same, False]
        if wait and wait[4]:
            ask[0] = False
        sent = ask.copy()
        if wait and wait[4]:
            sent[0] = True
        yield out(place[ask], shape[ask], gram[ask], np.ones(ask.sum(), bool))
        wait = (int(gram[-1]), int(content[-1]), int(place[-1]), int(shape[-1]), bool(sent[-1] or (len(gram) == 1 and wait is not None and wait[4])))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments that a text was asked for."""
    for b in batches:
        gram, place, shape, data, size = [], [], [], [], 0
        for x, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = (x or "").encode("utf-8", "surrogatepass")
            for r in asked:
                at = r["place"] & ((1 << OFFSET_BITS) - 1)
                gram.append(r["gram"])
                place.append(r["place"])
                shape.append(r["shape"])
                data.append(raw[at : at + (r["shape"] >> 7) + LENGTH - 1])
            size += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(place, pa.int64()), pa.array(shape, pa.int32()), pa.array(data, pa.binary())], names=["gram", "place", "shape", "data"])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of a text of ranks, ordered by their first ``depth`` symbols or more: prefix doubling."""
    rank, done = text, 1
    while done < depth:
        rank = np.unique(rank * (rank.max() + 1) + np.roll(rank, -done), return_inverse=True)[1].reshape(-1)
        done *= 2
    return np.argsort(rank, kind="stable")


def prefix_classes(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Class of each rotation of a text of ranks: those of equal first ``depth`` symbols have one class.

    Breadth-first over intervals of the transform. Level by level, each interval is extended by every
    symbol that precedes its rotations; the extended interval's right end is a place where common
    prefixes have the level's length, if no shorter one is known there. Places that stay open when the
    depth is reached have common prefixes of that depth at least.
    """
    n = len(text)
    order = suffix_order(text, depth)
    before = text[order - 1]
    back = np.empty(n, np.int64)  # where the rotation that starts one symbol earlier stands
    back[np.argsort(before, kind="stable")] = np.arange(n)
    head = text[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(depth):
        size = high - low + 1
        rows = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        to = back[rows]
        owner = np.repeat(np.arange(len(low)), size)
        if len(to) * 8 < n:
            by = np.argsort(to)
            to, owner = to[by], owner[by]
        else:
            at = np.full(n, -1)
            at[to] = owner
            to = np.flatnonzero(at >= 0)
            owner = at[to]
        new = np.r_[True, (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (head[to[1:]] != head[to[:-1]])]
        low, high = to[new], to[np.r_[np.flatnonzero(new)[1:] - 1, len(to) - 1]]
        fresh = ~known[high + 1]
        # The interval whose end is known may still hold new ones inside; its end was set by one as long.
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
        if not len(low):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(known[:n])
    return out


def repeats(data: list[bytes], rel: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments in the order of their places: segment, first window and number of windows of each run that repeats earlier windows."""
    size = np.array([len(x) for x in data])
    raw = np.frombuffer(b"".join(data), np.uint8)
    off = np.cumsum(size) - size
    lead = rel % SYMBOL
    count = (size - lead) // SYMBOL
    base = np.cumsum(count + 1) - (count + 1)  # a separator follows each segment
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(off + lead, count) + k * SYMBOL
    symbols = raw[at[:, None] + np.arange(SYMBOL)].view(_U).reshape(-1)
    text = np.zeros(int((count + 1).sum()), np.int64)
    text[np.repeat(base, count) + k] = np.unique(symbols, return_inverse=True)[1].reshape(-1) + 1
    cls = prefix_classes(text)
    held = np.bincount(cls)
    seg = np.repeat(np.arange(len(data)), windows)
    w = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    x = (rel[seg] - w) % SYMBOL
    c = cls[base[seg] + (w + x - lead[seg]) // SYMBOL]
    go = np.flatnonzero(held[c] > 1)
    seg, w, x, c = seg[go], w[go], x[go], c[go]
    if not len(seg):
        return seg, w, x
    edge = LENGTH - DEPTH * SYMBOL
    start = off[seg] + w
    mixed = c.astype(_U) * _U(_P) + (rel[seg] - w + LENGTH).astype(_U)
    for t in range(edge):
        mixed = (mixed ^ (mixed >> _U(29))) * _U(0xC2B2AE3D27D4EB4F) + raw[start + t + np.where(t < x, 0, DEPTH * SYMBOL)]
    order = np.argsort(mixed, kind="stable")
    again = np.zeros(len(order), bool)
    again[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    seg, w = seg[again], w[again]
    if not len(seg):
        return seg, w, w
    new = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (w[1:] != w[:-1] + 1)])
    return seg[new], w[new], np.diff(np.r_[new, len(seg)])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and window counts that repeat earlier windows, from segments in the order of their grams; blocks hold whole grams."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
    bytes_ = 0

    def flush(parts) -> pa.RecordBatch:
        place, shape = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
        data = [x for p in parts for x in p[3]]
        order = np.argsort(place, kind="stable")
        place, shape, data = place[order], shape[order], [data[i] for i in order.tolist()]
        seg, w, n = repeats(data, shape & 127, shape >> 7)
        return pa.RecordBatch.from_arrays([pa.array(place[seg] + w), pa.array(n.astype(np.int64))], names=["place", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        gram, place, shape, data = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
        cuts = np.r_[0, np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and bytes_ > BLOCK and held[-1][0] != gram[lo]:
                yield flush(held)
                held, bytes_ = [], 0
            held.append((gram[lo], place[lo:hi], shape[lo:hi], data[lo:hi]))
            bytes_ += sum(map(len, data[lo:hi]))
    if held:
        yield flush(held)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed bytes, runs and the digest of what is left, from texts and their repeated windows."""
    for b in batches:
        ords, removed, runs, digest = [], [], [], []
        for i, x, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = (x or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for r in sorted((s["start"], s["start"] + s["n"] + LENGTH - 1) for s in spans):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            left, at = hashlib.sha256(), 0
            for lo, hi in merged:
                left.update(raw[at:lo])
                at = hi
            left.update(raw[at:])
            ords.append(i)
            removed.append(sum(hi - lo for lo, hi in merged))
            runs.append(len(merged))
            digest.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["ord", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and ord: the id itself where ids are distinct and small, else a number in the order of ids (null last), then texts."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ok = d.agg(F.count("*").alias("n"), F.count("id").alias("k"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    if not ok["n"]:
        return d.withColumn("ord", F.lit(0).cast("long"))
    if ok["n"] == ok["k"] and ok["a"] >= 0 and ok["b"] < 1 << (63 - OFFSET_BITS) and d.groupBy("id").count().filter("count > 1").isEmpty():
        return d.withColumn("ord", F.col("id").cast("long"))
    d = d.orderBy(F.col("id").asc_nulls_last(), "text")
    return cut(d.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(f"id {dict(d.dtypes)['id']}, text string, ord long"), "substring-numbers")


_CODED = "code long, content long, place long"


def _met(coded: DataFrame) -> DataFrame:
    """Equal segments meet in one exchange, in the order of gram, content and place."""
    coded = coded.withColumn("gram", F.shiftrightunsigned("code", 14)).repartition("gram").sortWithinPartitions("gram", "content", "place")
    return coded.select("code", "content", "place").mapInArrow(freed(_compare), "place long, shape int, gram long, ask boolean")


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id column, n_bytes, n_removed, n_spans and kept_sha256 for every row.

    A null text is an empty one; a text under 100 bytes loses nothing. Rows of one id, or of null ids
    (which come last), are separate texts in the order of their texts. An empty table gives no rows;
    further columns are not read. Equal places are told by 64-bit hashes of content with 50-bit hashes
    of grams, not by bytes. A text of 2^OFFSET_BITS bytes or more is refused with a ValueError.
    """
    tune(docs.sparkSession)
    d = _numbered(docs, id_col, text_col)
    low = (1 << OFFSET_BITS) - 1
    found = cut(_met(d.select("ord", "text").mapInArrow(freed(_occurrences), _CODED)), "substring-places")
    number = F.shiftright("place", OFFSET_BITS)
    asked = found.filter("ask").groupBy(number.alias("ord")).agg(F.collect_list(F.struct("place", "shape", "gram")).alias("asked"))
    segs = d.select("ord", "text").join(asked, "ord").select("text", "asked").mapInArrow(freed(_fetch), "gram long, place long, shape int, data binary")
    crowded = found.filter("ask").groupBy("gram").count().filter(F.col("count") > MOST_CONTEXTS).select("gram")
    split = not crowded.isEmpty()
    if split:
        crowded = cut(crowded, "substring-crowded")
        single = _met(segs.join(crowded, "gram", "left_semi").mapInArrow(freed(_single_windows), _CODED)).filter(~F.col("ask"))
        segs = segs.join(crowded, "gram", "left_anti")
    inner = segs.repartition("gram").sortWithinPartitions("gram").mapInArrow(freed(_expand), "place long, n long")
    outer = found.filter(~F.col("ask")).select("place", F.shiftright("shape", 7).cast("long").alias("n"))
    if split:
        inner = inner.union(single.select("place", F.lit(1).cast("long").alias("n")))
    spans = outer.union(inner).groupBy(number.alias("ord")).agg(F.collect_list(F.struct(F.col("place").bitwiseAND(low).alias("start"), "n")).alias("spans"))
    cleaned = d.select("ord", "text").join(spans, "ord").mapInArrow(freed(_strip), "ord long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit(""))
    base = d.select("id", "ord", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    out = base.join(cleaned, "ord", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 100-byte strings."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT))) AS i FROM h WHERE length(h) >= 200)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM w),
d AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r WHERE k > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM d),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM s
      UNION ALL SELECT h.doc_id, coalesce(max(s.hi), 0), CAST(length(any_value(h.h)) // 2 AS BIGINT) FROM h LEFT JOIN s USING (doc_id) GROUP BY h.doc_id),
t AS (SELECT p.doc_id, string_agg(substr(h, CAST(2 * p.lo + 1 AS BIGINT), CAST(2 * (p.hi - p.lo) AS BIGINT)), '' ORDER BY p.lo, p.hi) AS kept FROM p JOIN h USING (doc_id) GROUP BY p.doc_id)
SELECT h.doc_id, CAST(length(h.h) // 2 AS BIGINT) AS n_bytes, CAST((length(h.h) - length(t.kept)) // 2 AS BIGINT) AS n_removed,
       (SELECT count(*) FROM s WHERE s.doc_id = h.doc_id) AS n_spans, sha256(unhex(t.kept)) AS kept_sha256
FROM h JOIN t USING (doc_id)
"""

QUERIES = {"op6_substrings": op6_substrings}
ORACLES = {"op6_substrings": _SQL}
