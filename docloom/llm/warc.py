"""WARC archives: writing, and reading back by boundary-chain verification.

Archives are written by Spark's text writer, a record a row, so that any file system and any lost
task is served by Spark's own commit protocol. They are read by Spark's text reader in blocks that
Spark splits at will, cut where a blank line is followed by the magic ``WARC/1.``. (A cut at blank lines
alone would depend on where a block begins: line ends in a row can be paired in two ways. This mark cannot
overlap itself.) Every block emits candidates: places where the magic stands with a header below it, and the
offset at which the successor must start. Payloads may hold the same mark; so a candidate counts only if it
is reached from the start of its file. Inside a block the chain is followed at once; between blocks,
pointer jumping over one exit pointer per candidate doubles the blocks that are crossed in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import cut, freed, new_path, table, tune

END = "\r\n\r\n"
MAGIC = b"WARC/1."
MARK = END.encode() + MAGIC
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads that repeat, of 60 bytes each, that are sent to all executors at most; beyond it, a shuffle joins them.
BROADCAST_ROWS = 200_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1."""
    return base32(F.sha1(data))


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them give four letters."""
    number = lambda i: F.conv(F.substring(hexadecimal, i * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda v, shift: F.substring(F.lit(_BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[F.concat(*[letter(number(i), s) for s in (15, 10, 5, 0)]) for i in range(8)])


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of each page.

    Of the pages with equal payloads of ``least`` bytes or more, the one of largest page_id is the
    response and the others revisit it. A null html is an empty payload. Pages with a null id are
    responses of their own. Rows that repeat the largest page_id with the same payload are all
    responses.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1("html"))
    last = p.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha1", "last")
    last = cut(last, "warc-repeated")
    p = p.join(F.broadcast(last) if last.count() <= BROADCAST_ROWS else last, "sha1", "left").withColumn("payload_digest", base32(F.col("sha1")))
    again = (F.col("payload_bytes") >= least) & (F.col("page_id") < F.col("last"))
    return p.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record for each page to archives under ``path``; a revisit has no payload of its own.

    ``date`` is the time that records state. Pages with a null id get an identifier from their address and payload. Payloads of
    any length up to what a row holds (2 GB) are written whole; an empty table gives archives without records.
    """
    p = with_revisits(pages, least)
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws(" ", "url", "payload_digest")), F.lit(">")))),
        F.lit(f"\r\nWARC-Date: {date}"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]+", "%20")),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string")),
        F.lit(END), F.when(revisit, "").otherwise(F.col("html")),
    )
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between marks with their file, block and order; a file's blocks hold each piece once."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", MARK.decode()).text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))


def _header(head: bytes) -> dict[bytes, bytes] | None:
    """Fields of a record's header, or null if it has no proper length."""
    out = {}
    for x in head.split(b"\r\n")[1:]:
        name, colon, value = x.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out if out.get(b"content-length", b"").isdigit() else None


def _record(block: int, size: int, value: bytes) -> tuple[int, bytes, int] | None:
    """Start (in the block's pieces), header and place of the payload in the value and its mark, if a piece begins like a record.

    All pieces but a file's first follow a mark, whose magic belongs to them.
    """
    lead = 0 if block == 0 and size == 0 else len(MAGIC)
    head = value[: (value + MARK[:4]).find(MARK[:4])]  # the header's blank line may lie in the mark, if the payload goes on with the magic
    if not head or (not lead and not value.startswith(MAGIC)):
        return None
    return size - lead, head if not lead else MAGIC + head, len(head) + 4


_CANDIDATES = "file string, block long, start long, exit long, last long, size long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: its size (start null) and its candidates with the exit of their chain, all from the block's first piece.

    exit: where the chain of records leaves the block's candidates; last: the last record on it.
    """
    key, found, size = None, {}, 0

    def flush() -> list[tuple]:
        out = [(*key, None, None, None, size)]
        done: dict[int, tuple[int, int]] = {}
        for s in sorted(found, reverse=True):
            done[s] = done.get(found[s], (found[s], s))
            out.append((*key, s, *done[s], None))
        return out

    rows: list[tuple] = []
    for b in batches:
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (file, block) != key:
                if key is not None:
                    rows += flush()
                key, found, size = (file, block), {}, 0
            if (r := _record(block, size, value)) is not None and (h := _header(r[1])) is not None:
                found[r[0]] = size + r[2] + int(h[b"content-length"]) + 4
            size += len(value) + len(MARK)
        if len(rows) > 10_000:
            yield _batch(rows)
            rows = []
    if key is not None:
        rows += flush()
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "block", "start", "exit", "last", "size"])


def entries(spark: SparkSession, path: str) -> DataFrame:
    """For each block: file, block, base (offset of its first piece), entry (its first true record or null) and open.

    Tables of the rounds hold a row or few for each block, and so go into a few files.

    open: the record that reaches into the block from an earlier one, as an offset in the file.
    """
    tune(spark)
    found = _chunks(spark, path).mapInArrow(freed(_candidates), _CANDIDATES).persist()
    order = Window.partitionBy("file").orderBy("block")
    blocks = found.filter(F.col("start").isNull()).select("file", "block", (F.sum("size").over(order) - F.col("size")).alias("base"))
    cand = found.filter(F.col("start").isNotNull()).join(blocks, ["file", "block"]).select("file", "block", *[(F.col(c) + F.col("base")).alias(c) for c in ("start", "exit", "last")])
    # A record is an entry of its block if it starts the file or an earlier chain exits there.
    cand = cand.join(cand.select("file", F.col("exit").alias("start")).distinct().withColumn("to", F.lit(True)), ["file", "start"], "left")
    cand = cand.filter(F.col("to") | (F.col("start") == 0)).drop("to")
    files = max(1, cand.count() // 500_000)
    cand = cut(cand.coalesce(files), "warc-chain")
    reached = cand.filter("start = 0").select("file", "start")
    jump = cand.select("file", "start", F.col("exit").alias("next"))
    n, rounds = reached.count(), 0
    while True:
        step = reached.join(jump, ["file", "start"]).select("file", F.col("next").alias("start")).join(cand.select("file", "start"), ["file", "start"], "left_semi")
        reached = cut(reached.union(step).distinct().coalesce(files), "warc-reached")
        now = reached.count()
        if now == n and rounds:
            break
        n, rounds = now, rounds + 1
        jump = cut(jump.join(jump.select("file", F.col("start").alias("next"), F.col("next").alias("then")), ["file", "next"], "left").select("file", "start", F.coalesce("then", "next").alias("next")).coalesce(files), "warc-jump")
    first = cand.join(reached, ["file", "start"], "left_semi").groupBy("file", "block").agg(F.min("start").alias("entry"), F.max("last").alias("last"))
    blocks = blocks.join(first, ["file", "block"], "left")
    out = cut(blocks.select("file", "block", "base", "entry", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("open")), "warc-entries")
    found.unpersist()
    return out


_PARTS = "file string, record long, at long, header binary, length long, data binary"


def _parts(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
    """Records that lie wholly inside a block (if ``want``), or else what blocks hold of the others, by offset."""
    out: list[tuple] = []
    held = 0
    key = base = due = None
    size = 0
    record: list | None = None  # start, header, length, offset of the bytes held, bytes held

    def put(file: str, r: list) -> None:
        nonlocal held
        data = bytes(r[4]) if r[2] is None else bytes(r[4][: r[2]])
        if r[1] is None and not data:
            return
        if (r[2] is not None and len(data) == r[2]) == want:
            out.append((file, r[0], r[3], r[1], r[2], data))
            held += len(data)

    for b in batches:
        for file, block, value, start, entry, open_ in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (file, block) != key:
                if record is not None:
                    put(key[0], record)
                key, base, size = (file, block), start, 0
                due = entry
                record = [open_, None, None, base, bytearray()] if open_ is not None else None
            r = _record(block, size, value)
            if due is not None and r is not None and base + r[0] == due:
                if record is not None:
                    put(file, record)
                length = int(_header(r[1])[b"content-length"])
                body = base + size + r[2]
                record = [due, r[1], length, body, bytearray((value + MARK)[r[2] :])]
                due = body + length + 4
            elif record is not None:
                record[4] += value + MARK
            size += len(value) + len(MARK)
            if held > 2 << 20 or len(out) > 5000:
                yield _part_batch(out)
                out, held = [], 0
    if record is not None:
        put(key[0], record)
    if out:
        yield _part_batch(out)


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "record", "at", "header", "length", "data"])


def read(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """file, record (offset), header (map of lower-case names) and payload of every true record under ``path``.

    The entries of blocks are broadcast if there are at most ``most`` blocks, and joined by a sort
    else. Records that cross blocks are put together from their parts, by offset.
    """
    at = entries(spark, path)
    key = ["file", "block"]
    if at.count() <= most:
        rows = _chunks(spark, path).join(F.broadcast(at), key)
    else:
        rows = _chunks(spark, path).withColumn("n", F.monotonically_increasing_id()).join(at, key).repartition(*key).sortWithinPartitions(*key, "n")
    rows = rows.select("file", "block", "value", "base", "entry", "open")
    whole = rows.mapInArrow(freed(lambda batches: _parts(batches, True)), _PARTS)
    split = rows.mapInArrow(freed(lambda batches: _parts(batches, False)), _PARTS)
    split = split.groupBy("file", "record").agg(F.max("header").alias("header"), F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))
    split = split.filter(F.col("header").isNotNull())  # else blanks after a record that was whole
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    split = split.withColumn("joined", joined).select("file", "record", "header", F.expr("substring(joined, 1, cast(length as int))").alias("payload"))
    both = whole.select("file", "record", "header", F.col("data").alias("payload")).union(split)
    # The first line is the version; of a repeated field, the first value counts, as for lengths.
    lines = F.slice(F.split(F.decode("header", "UTF-8"), "\r\n"), 2, 1 << 30)
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    named = F.struct(pairs.alias("p"), F.transform(pairs, lambda x: x["k"]).alias("k"))
    first = lambda b: F.filter(b["p"], lambda x, i: F.array_position(b["k"], x["k"]) == i + 1)
    pairs = F.get(F.transform(F.array(named), first), F.lit(0))
    return both.select("file", "record", F.map_from_entries(pairs).alias("header"), "payload")


def digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that were read.

    A response's size and digest are those of the bytes that were read; a revisit's are stated in its header.
    """
    h = lambda name: F.try_element_at("header", F.lit(name))
    revisit = h("warc-type") == "revisit"
    number = lambda name: F.regexp_extract(h(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.select(
        number("warc-record-id").alias("page_id"),
        F.when(revisit, h("x-payload-length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(h("warc-payload-digest"), "^sha1:", "")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        h("warc-type").alias("record_type"),
        F.when(revisit, number("warc-refers-to")).alias("refers_to"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back."""
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return digest(read(spark, path))


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest FROM d),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to FROM l
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": _SQL}
