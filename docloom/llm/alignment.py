"""Cross-tokenizer alignment by segment deduplication.

A text is cut before those runs of white space across which neither vocabulary can merge, which is verified on the two
files. Equal segments are counted; each distinct one is tokenised by both libraries and aligned once. Its id pairs, weighted by its
count, give the counts of all pairs of the corpus. Texts then become rows of places in a table of segments: the most frequent
segments travel to the tasks, the others meet their alignments in a shuffle, once for some MB of texts that hold them. So no key
is hot, nothing is tokenised twice, and a text's alignment is composed of those of its segments.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, freed, table, tune
from .pieces import MARK, default_model, model_type

#: Segments that travel to every task at most, and bytes of these at most; distinct segments and characters that a task counts before it gives them on.
HEAD, HEAD_BYTES, HELD, HELD_CHARS = 500_000, 48 << 20, 1_000_000, 64 << 20
#: Id pairs whose counts travel to every task at most (16 bytes each); beyond it, links and pairs meet in a salted shuffle.
PAIRS, SALTS = 1 << 21, 32
#: Characters of texts of one row of places.
TEXT_CHARS = 4 << 20
#: Characters of segments that are tokenised at once.
CALL_CHARS = 1 << 20
#: Segments up to this size are their own key; longer ones have a digest of 128 bits.
KEY_BYTES = 16

_SEGMENT = re.compile(r"\s*+\S++(?:(?! )\s++\S++)*+(?:\s++\Z)?+|\s++")
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Of these three and its groups a segment's other numbers follow.
_KEPT = ("n_a", "n_best", "count_sum")
#: Where a text cannot simply be split at its blanks: blanks side by side or at its ends, and other white space before a blank or at an end.
_ODD = re.compile(r"\s |\s\Z|\A\s")


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def segments(text: str) -> list[str]:
    """Parts of a text that has a blank in front, each without its own leading blank.

    It is cut before each run of white space that begins with a blank, and that other characters come before and after.
    """
    return [x[1:] for x in _SEGMENT.findall(" " + text)] if _ODD.search(text) else text.split(" ")


class Pair:
    """Two vocabularies: the bytes of their tokens, and whether texts may be cut before blanks."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        data = Path(a_path).read_text(encoding="utf-8")
        self.a = Tokenizer.from_str(data)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.blank = self.b.piece_to_id(MARK)
        back = byte_of()
        special = {x["id"] for x in json.loads(data)["added_tokens"]}
        n = max(chain(self.a.get_vocab(with_added_tokens=True).values(), [0])) + 1
        self.a_bytes = [b"" if i in special else bytes(back[c] for c in self.a.id_to_token(i) or "") for i in range(n)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = self.verified(json.loads(data), Path(b_path).read_bytes())

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace(MARK, " ").encode()

    def verified(self, a: dict, b: bytes) -> bool:
        """Whether no token of either vocabulary can hold a character and a blank after it, and texts reach both as they are.

        A: words are split before blanks by its own rule, which looks at what follows only. B: no piece has a mark behind another
        character, so no merge joins the two; its settings leave texts alone.
        """
        pre = a.get("pre_tokenizer") or {}
        try:
            model_type(b)
        except Exception:  # settings that change texts
            return False
        plain = a.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not a["model"].get("dropout")
        return bool(plain) and not any(re.search(f"[^{MARK}]{MARK}", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

    def of(self, text: str) -> list[str]:
        """Segments of a text; none if the vocabularies cannot give its bytes back."""
        if not self.cuts:
            return [text]
        return [] if MARK in text else segments(text)

    def encoded(self, parts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both vocabularies for segments, which get their blank back in front."""
        for at in range(0, len(parts), 4096):
            mine = parts[at : at + 4096]
            a = self.a.encode_batch_fast([" " + x for x in mine], add_special_tokens=False)
            yield from ((x.ids, y or [self.blank]) for x, y in zip(a, self.b.encode(mine, num_threads=1)))


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def align(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[str, list[int]]:
    """Groups as text, and all pairs (id of A times 2^32 and id of B) of tokens whose bytes overlap; both sides have the same bytes."""
    i = j = 0
    x, y = size_a[a[0]], size_b[b[0]]
    groups, links = [], [a[0] << 32 | b[0]]
    left, right = str(a[0]), str(b[0])
    while True:
        if x == y:
            groups.append(f"{left}|{right}")
            i += 1
            j += 1
            if i == len(a):
                return ";".join(groups), links
            x += size_a[a[i]]
            y += size_b[b[j]]
            left, right = str(a[i]), str(b[j])
        elif x < y:
            i += 1
            x += size_a[a[i]]
            left += f",{a[i]}"
        else:
            j += 1
            y += size_b[b[j]]
            right += f",{b[j]}"
        links.append(a[i] << 32 | b[j])


def key_of(part: str) -> bytes:
    x = part.encode()
    return x if len(x) < KEY_BYTES else xxhash.xxh3_128_digest(x)


def _counts(a_path: str, b_path: str):
    """A function of batches of texts: segments with how often they occur, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, size = pair(a_path, b_path), Counter(), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.large_string()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["part", "n"])

        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    held.update(p.of(x))
                    size += len(x)
            if len(held) > HELD or size > HELD_CHARS:
                yield flush()
                held, size = Counter(), 0
        if held:
            yield flush()

    return run


def _aligned(a_path: str, b_path: str):
    """A function of batches (part, n): key, n, groups, tokens of A and links (id of A times 2^32 and id of B) of each segment; segments whose bytes are not given back are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        size_a, size_b = [len(x) for x in p.a_bytes], [len(x) for x in p.b_bytes]

        def some(parts: list[str], counts: list[int]) -> pa.RecordBatch:
            rows = []
            for x, n, (a, b) in zip(parts, counts, p.encoded(parts)):
                own = b" " + x.encode()
                if b"".join([p.a_bytes[i] for i in a]) != own or b"".join([p.b_bytes[i] for i in b]) != own:
                    if p.cuts:
                        raise ValueError(f"a verified vocabulary does not give a segment's bytes back: {x[:100]!r}")
                    continue
                groups, links = align(a, b, size_a, size_b)
                rows.append((key_of(x), n, groups, len(a), links))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "n", "groups", "n_a", "links"])

        for b in batches:
            parts, counts, at, size = b.column(0).to_pylist(), b.column(1).to_pylist(), 0, 0
            for k, x in enumerate(parts):
                size += len(x)
                if size > CALL_CHARS:
                    yield some(parts[at : k + 1], counts[at : k + 1])
                    at, size = k + 1, 0
            yield some(parts[at:], counts[at:])

    return run


_ALIGNED = "key binary, n long, groups string, n_a long, links array<long>"
_B = 0xFFFFFFFF


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every distinct segment of the texts (text), tokenised and aligned once: written to the shared folder."""
    parts = docs.select("text").mapInArrow(freed(_counts(a_path, b_path)), "part string, n long")
    each = parts.groupBy("part").agg(F.sum("n").alias("n"))
    return cut(each.mapInArrow(freed(_aligned(a_path, b_path)), _ALIGNED), "align-segments")


def pair_counts(segs: DataFrame) -> DataFrame:
    """link, n (how many links of the corpus have it) and best (whether no other link of its B id has more)."""
    n = segs.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("n"))
    n = cut(n, "align-pairs")
    top = n.groupBy(F.col("link").bitwiseAND(_B).alias("b")).agg(F.max("n").alias("top"))  # a row an id of B
    return n.withColumn("b", F.col("link").bitwiseAND(_B)).join(top, "b").select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def with_counts(segs: DataFrame) -> DataFrame:
    """key, n, groups and all numbers of each segment, n_best and count_sum too."""
    pairs = cut(pair_counts(segs), "align-counts")
    keep = ("key", "n", "groups", "n_a")
    if pairs.count() <= PAIRS:
        got = pairs.toArrow().sort_by("link")
        link, n, best = (got.column(i).to_numpy() for i in range(3))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                links = b.column(4)
                at = np.searchsorted(link, links.flatten().to_numpy())
                ends = np.r_[0, np.cumsum(links.value_lengths().to_numpy())]
                sums = [np.r_[0, np.cumsum(x[at])] for x in (best.astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], names=[*keep, "n_best", "count_sum"])

        return segs.select(*keep, "links").mapInArrow(freed(run), "key binary, n long, groups string, n_a long, n_best long, count_sum long")
    salted = segs.select("key", F.explode("links").alias("link"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    met = salted.join(pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["link", "salt"])
    sums = met.groupBy("key").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    return segs.select(*keep).join(sums, "key")


def _numbers(groups: list[str], kept: np.ndarray) -> np.ndarray:
    """All numbers of segments from their groups and the numbers that are kept: a group of tokens that meet has one link fewer than tokens."""
    n = np.array([x.count(";") + 1 for x in groups], np.int64)
    ids = np.array([x.count(",") for x in groups], np.int64) + 2 * n
    return np.stack([kept[:, 0], ids - kept[:, 0], n, ids - n, kept[:, 1], kept[:, 2]], 1)


def least_count(segs: DataFrame) -> int:
    """The least number of occurrences that at most HEAD segments have; found on counts of counts, which are kept by their first two digits."""
    n = F.col("n")
    scale = F.pow(F.lit(10), F.greatest(F.floor(F.log10("n")) - 1, F.lit(0))).cast("long")
    rows = segs.filter(F.length("groups") < 200).groupBy((F.floor(n / scale) * scale).cast("long").alias("low")).count().collect()  # some 90 rows a power of ten
    total, least = 0, 0
    for r in sorted(rows, key=lambda r: -r["low"]):
        total += r["count"]
        if total > HEAD:
            break
        least = r["low"]
    return least or 1 << 62


def _planes(code: np.ndarray) -> bytes:
    """Places, all their low bytes first, then the next ones: so they compress."""
    return code.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _places(a_path: str, b_path: str, head: dict[bytes, int]):
    """A function of batches (id, text): a row for some MB of texts, with the place of each segment in the head or, below zero, among the keys to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        own = {k.decode(): i for k, i in head.items() if len(k) < KEY_BYTES}  # longer segments are known by their digests
        ids, ends, seqs, rest, n, size = [], [], [], {}, 0, 0
        packer = zstandard.ZstdCompressor(3)

        def flush() -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (ends, pa.int64()), (list(rest), pa.binary()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([packer.compress(_planes(np.concatenate(seqs)))], pa.binary())], names=["ids", "ends", "keys", "seq"])

        def place(x: str) -> int:
            k = key_of(x)
            i = head.get(k)
            return -1 - rest.setdefault(k, len(rest)) if i is None else i

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = p.of(x) if x else []
                at = list(map(own.get, parts))
                if None in at:
                    at = [place(parts[k]) if v is None else v for k, v in enumerate(at)]
                n += len(parts)
                ids.append(i)
                ends.append(n)
                seqs.append(np.array(at, np.int32))
                size += len(x or "")
            if size >= TEXT_CHARS:
                yield flush()
                ids, ends, seqs, rest, n, size = [], [], [], {}, 0, 0
        if ids:
            yield flush()

    return run


def _composed(head_text: list[str], head_numbers: np.ndarray):
    """A function of batches of places with their joined alignments: a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, ends, far, seq, got = (b.column(i)[r] for i in range(5))
                code = _from_planes(zstandard.ZstdDecompressor().decompress(seq.as_py()))
                ends, far = ends.values.to_numpy(), far.as_py()
                # Segments that are not joined have no tokens: those of vocabularies that do not give their bytes back.
                text: list[str | None] = [None] * far
                numbers = np.zeros((far, len(_NUMBERS)), np.int64)
                if got.is_valid:
                    j = got.values.field("j").to_numpy()
                    groups = got.values.field("groups").to_pylist()
                    for k, x in zip(j.tolist(), groups):
                        text[k] = x
                    numbers[j] = _numbers(groups, np.stack([got.values.field(c).to_numpy() for c in _KEPT], 1))
                start = np.r_[0, ends[:-1]]
                sums = np.zeros((len(ends), len(_NUMBERS)), np.int64)
                known = code >= 0
                own = np.repeat(np.arange(len(ends)), ends - start)
                for c in range(len(_NUMBERS)):
                    v = np.empty(len(code), np.int64)
                    v[known] = head_numbers[code[known], c]
                    v[~known] = numbers[-1 - code[~known], c]
                    total = np.r_[0, np.cumsum(v)]
                    sums[:, c] = total[ends] - total[start]
                lost = np.zeros(len(ends), bool)
                gone = np.flatnonzero([x is None for x in text])
                if len(gone):
                    lost[np.unique(own[np.isin(code, -1 - gone)])] = True
                    sums[lost] = 0
                digests = []
                for k in range(len(ends)):
                    mine = code[start[k] : ends[k]].tolist()
                    digests.append("" if lost[k] or not mine else sha256(";".join([head_text[c] if c >= 0 else text[-1 - c] for c in mine]).encode()).hexdigest())
                for at in range(0, len(ends), 1000):
                    s = slice(at, at + 1000)
                    yield pa.RecordBatch.from_arrays([ids.values[s], *(pa.array(sums[s, c]) for c in range(len(_NUMBERS))), pa.array(digests[s], pa.string())], names=["doc_id", *_NUMBERS, "groups_sha256"])

    return run


def aligned(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Null and empty texts, and those whose bytes one of the vocabularies does not give back, have no tokens: zeros and an empty
    digest. Rows that repeat count as often as they are there and give equal rows; a null id stays null. Of pairs with equal
    counts all are best. Texts of any length are cut, counted and composed whole; one without blanks is one segment. An empty table
    gives no rows. Further columns, whatever their names, are not read. Vocabularies that cannot be verified get whole texts as segments.
    """
    spark = df.sparkSession
    tune(spark)
    a, b = a_path or default_a(), b_path or default_model()
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    segs = alignments(docs, a, b)
    full = with_counts(segs)
    often = (F.col("n") >= least_count(segs)) & (F.length("groups") < 200)
    rows = full.filter(often).toArrow().sort_by([("n", "descending"), ("key", "ascending")])
    rows = rows.slice(0, int(np.searchsorted(np.cumsum([len(x) + 16 for x in rows.column("groups").to_pylist()] or [0]), HEAD_BYTES)))
    head = {k: i for i, k in enumerate(rows.column("key").to_pylist())}
    groups = rows.column("groups").to_pylist()
    numbers = _numbers(groups, np.stack([rows.column(c).to_numpy() for c in _KEPT], 1)) if groups else np.zeros((0, len(_NUMBERS)), np.int64)
    parts = cut(docs.mapInArrow(freed(_places(a, b, head)), "ids array<long>, ends array<long>, keys array<binary>, seq binary").withColumn("row", F.xxhash64("ids", F.md5("seq"), F.monotonically_increasing_id())), "align-places")
    far = parts.select("row", F.posexplode("keys").alias("j", "key")).join(full.drop("n"), "key")
    got = far.groupBy("row").agg(F.collect_list(F.struct("j", "groups", *_KEPT)).alias("got"))
    out = parts.select("row", "ids", "ends", F.size("keys").alias("far"), "seq").join(got, "row", "left").select("ids", "ends", "far", "seq", "got")
    return out.mapInArrow(freed(_composed(groups, numbers)), "doc_id long, " + ", ".join(f"{x} long" for x in _NUMBERS) + ", groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both vocabularies on every document."""
    return aligned(table(spark, sf_dir, "documents"))


QUERIES = {"op12_alignment": op12_alignment}
#: SQL has no tokenizers: tests hold it against a plain version over whole texts.
ORACLES: dict[str, str] = {}
