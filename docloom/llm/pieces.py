"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are marked (blank -> U+2581, one mark put before the text) and cut into words at each mark
that follows another character, and at line ends; no piece crosses such a place, which ``Vocabulary`` checks. The
distinct marked words of a batch are sorted, so that they form a trie read depth-first: a word keeps
the forward states of the prefix it shares with its predecessor and computes only the rest.

The forward state of a prefix is the last piece of its best segmentation and where that piece
starts. For a unigram model it is the Viterbi state (best sum of scores). For a BPE model, best
means the segmentation that merging yields: a piece may end a prefix only if the merges of the
previous piece and this one leave the two apart, and exactly one such piece exists.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, types as T

from .common import append

MARK = "▁"
#: Bytes of words and ids after which a Python worker starts a new memory; words of the last one that come again move over.
REMEMBERED = 20 << 20
#: Pairs of pieces whose parting is remembered at most (about 75 bytes each).
PAIRS = 300_000
#: Texts whose words are held at once.
SLICE = 500
#: Words of more characters are encoded by back pointers and not remembered: packed ids of every prefix take memory quadratic in a word's length.
LONG = 256
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and raw value of each field of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialised model; a model whose settings change texts in ways not followed here is refused."""
    top: dict[int, list] = {1: [], 2: [], 3: []}
    for k, v in _fields(proto):
        if k in top:
            top[k].append(v)
    trainer = dict(x for v in top[2] for x in _fields(v))
    normal = dict(x for v in top[3] for x in _fields(v))
    # Field numbers and defaults of the public model format.
    wrong = {
        "normalises characters": bool(normal.get(2)),
        "puts no mark first": not normal.get(3, 1),
        "removes blanks": bool(normal.get(4, 1)),
        "keeps blanks unmarked": not normal.get(5, 1),
        "marks word ends": bool(trainer.get(24, 0)),
        "has pieces defined by its user": any(dict(_fields(v)).get(3, 1) == 4 for v in top[1]),
        "is neither of the unigram nor of the BPE kind": trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE),
    }
    if found := [k for k, v in wrong.items() if v]:
        raise ValueError("this model is not supported, as it " + ", ".join(found))
    return trainer.get(3, UNIGRAM)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, and the encoding of single words."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = model_type(sp.serialized_model_proto())
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.byte_of}
        self.score = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        least = min((self.score[i] for i in self.ids.values()), default=0.0)
        self.unknown_score = least - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark inside: words cannot be cut at marks")
        self.plant()

    def plant(self) -> None:
        """The tree of pieces: a node's "" holds its piece, the packed id, whether merging makes the piece (found out when first asked), and the id."""
        self.tree: dict = {}
        self.entry: dict[str, list] = {}
        for p, k in self.ids.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = self.entry[p] = [p, struct.pack("<i", k), True if len(p) == 1 else None, k]
        #: No piece crosses a line's end, so that words can be cut there as well.
        self.lines = not any("\n" in p for p in self.ids)
        self.parts: dict[int, bool] = {}  # of two ids in one number: whether merging leaves the two apart
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # packed ids of words
        self.before: dict[str, bytes] = {}
        self.held = 0

    def apart(self, a: list | None, b: list) -> bool:
        """Whether merging leaves pieces a and b apart; None stands for a character that is no piece."""
        if a is None:
            return True
        key = a[3] << 32 | b[3]
        if (got := self.parts.get(key)) is None:
            if len(self.parts) >= PAIRS:
                self.parts.clear()
            got = self.parts[key] = self.merge(a[0] + b[0]) == [a[0], b[0]]
        return got

    def merge(self, word: str) -> list[str]:
        """The pieces that merging leaves: the best adjacent pair first, the leftmost of equals."""
        part: list[str | None] = list(word)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(part) and (k := self.ids.get(s := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, s))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, s = heapq.heappop(heap)
            if part[i] is None or (j := right[i]) >= len(part) or part[i] + part[j] != s:
                continue
            part[i], part[j] = s, None
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [x for x in part if x is not None]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word: sorted words share the forward states of common prefixes."""
        out: dict[str, bytes] = {}
        before = ""
        # By place: the last piece, the sum of scores, the packed ids up to it, and where pieces begin that reach it and may go on.
        last, best, ids, open_ = [None], [0.0], [b""], [[]]
        root, entry, parts, bpe = self.tree.get, self.entry.get, self.parts.get, self.kind == BPE
        for w in sorted(words):
            if bpe and w.startswith(MARK * 2):
                out[w] = b"".join(map(self.pack, self.merge(w)))  # pieces of marks alone have equal scores
                continue
            if len(w) > LONG:
                out[w] = self.encode_long(w)
                continue
            keep, most = 0, min(len(before), len(w))
            while keep < most and before[keep] == w[keep]:
                keep += 1
            del last[keep + 1 :], best[keep + 1 :], ids[keep + 1 :], open_[keep + 1 :]
            now = open_[keep]
            for end, c in enumerate(w[keep:], keep + 1):
                now = [(at, n) for at, node in now if (n := node.get(c)) is not None]
                if bpe:
                    for at, node in now:
                        if (p := node.get("")) is not None and (p[2] or (p[2] is None and self.alone(p))):
                            a = last[at]
                            if a is None or (ok := parts(a[3] << 32 | p[3])) or (ok is None and self.apart(a, p)):
                                last.append(p)
                                ids.append(ids[at] + p[1])
                                break
                    else:
                        last.append(p := entry(c))
                        ids.append(ids[-1] + (self.pack(c) if p is None else p[1]))
                if (n := root(c)) is not None:
                    now.append((end - 1, n))
                open_.append(now)
                if not bpe:
                    self._viterbi(c, end, now, best, ids)
            before = w
            out[w] = ids[len(w)]
        return out

    def encode_long(self, w: str) -> bytes:
        """Packed ids of one word by the same forward pass, with a back pointer for each prefix: memory is linear in its length."""
        last, best, piece, back, now = [None], array("d", [0.0]), [b""], array("q", [0]), []
        for end, c in enumerate(w, 1):
            now = [(at, n) for at, node in now if (n := node.get(c)) is not None]
            start, text, packed, top = end - 1, self.entry.get(c), None, best[end - 1] + self.unknown_score
            one = [(end - 1, n)] if (n := self.tree.get(c)) is not None else []
            if self.kind == BPE:
                for at, node in now:
                    if (p := node.get("")) is not None and (p[2] or (p[2] is None and self.alone(p))) and self.apart(last[at], p):
                        start, text, packed = at, p, p[1]
                        break
            else:
                for at, node in now + one:
                    if (p := node.get("")) is not None and (sure := best[at] + self.score[p[3]]) > top:
                        start, packed, top = at, p[1], sure
            now += one
            last.append(text)
            best.append(top)
            piece.append(self.pack(c) if packed is None else packed)
            back.append(start)
        out, end = [], len(w)
        while end:
            out.append(piece[end])
            end = back[end]
        return b"".join(reversed(out))

    def alone(self, p: list) -> bool:
        p[2] = self.merge(p[0]) == [p[0]]
        return p[2]

    def _viterbi(self, c: str, end: int, now: list, best: list[float], ids: list[bytes]) -> None:
        top, packed = best[end - 1] + self.unknown_score, None
        for at, node in now:
            if (p := node.get("")) is not None and (sure := best[at] + self.score[p[3]]) > top:
                top, packed = sure, ids[at] + p[1]
        best.append(top)
        ids.append(ids[end - 1] + self.pack(c) if packed is None else packed)

    def pack(self, piece: str) -> bytes:
        """Packed id of a piece, of the bytes of a character that is none, or of the unknown piece."""
        if (k := self.ids.get(piece)) is not None:
            return struct.pack("<i", k)
        if self.bytes:
            return b"".join(struct.pack("<i", self.bytes[b]) for b in piece.encode("utf-8", "surrogatepass"))
        return struct.pack("<i", self.unknown)

    def packed(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of each whole text; null for a null text, none for an empty one."""
        cut = [split_marked(x, self.lines) if x is not None else None for x in texts]
        if self.held > REMEMBERED:
            self.before, self.known, self.held = self.known, {}, 0
        known, before = self.known, self.before
        new: set[str] = set()
        for ws in cut:
            if ws:
                new.update(ws)
        new.difference_update(known)
        again = new.intersection(before)
        known.update((w, before[w]) for w in again)
        fresh = {w: marked(w) for w in new - again}
        got = self.encode_words(list(set(fresh.values())))
        line = self.pack("\n")
        known.update((w, line + got[m] if w[0] == "\n" else got[m]) for w, m in fresh.items())
        rows = [None if ws is None else b"".join(map(known.__getitem__, ws)) for ws in cut]
        for w in new:
            if len(w) > LONG:
                del known[w]
            else:
                self.held += getsizeof(w) + getsizeof(known[w]) + 100  # the place in the table
        return rows

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each whole text."""
        return [None if x is None else np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids: byte pieces joined, marks turned into blanks, the first mark dropped."""
        if ids is None:
            return None
        raw = b"".join(map(self.table.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    @property
    def table(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            self._table = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else p.encode() for i, p in enumerate(self.pieces)]
        return self._table


def split_marked(text: str, lines: bool = True) -> list[str]:
    """Words of a text in a short form: a word after one mark stands without it, one after a line's end (if ``lines``) with that; else marks lead.

    A text without blanks is one word, lines or not.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    lines = lines and " " in text
    words = (text.replace("\n", " \n") if lines else text).split(" ")
    if "" not in words:
        return words if lines else [MARK + w if w[0] == "\n" else w for w in words]
    out, marks = [], ""
    for w in words:
        if lines and w[:1] == "\n":
            if marks:
                out.append(marks)
                marks = ""
            out.append(w)
            continue
        marks += MARK
        if w:
            out.append(w if marks == MARK and w[0] != "\n" else marks + w)
            marks = ""
    return [*out, marks] if marks else out


def marked(word: str) -> str:
    """The marked word of a short form, without a line's end before it."""
    return word[1:] if word[0] == "\n" else word if word[0] == MARK else MARK + word


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process; another model takes its place."""
    return Vocabulary(path)


def _arrow(rows: list[bytes | None]) -> pa.Array:
    """A column of id lists from packed rows."""
    ends = np.cumsum([0] + [len(x or b"") // 4 for x in rows]).astype(np.int32)
    gone = pa.array([x is None for x in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x or b"" for x in rows), np.int32)), mask=gone)


def encode(df: DataFrame, text_col: str = "text", model: str | None = None, out: str = "ids") -> DataFrame:
    """All columns and the ids of each whole text (null text: null; empty text: no ids)."""
    path = model or default_model()
    return append(df, text_col, [T.StructField(out, T.ArrayType(T.IntegerType()))], lambda texts: [_arrow(vocabulary(path).packed(texts))])


def decode(df: DataFrame, ids_col: str = "ids", model: str | None = None, out: str = "decoded") -> DataFrame:
    """All columns and the text of each row's ids (null ids: null)."""
    path = model or default_model()
    return append(df, ids_col, [T.StructField(out, T.StringType())], lambda rows: [[vocabulary(path).decode(x) for x in rows]])


def round_trip(df: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """All columns, ids, n_tokens and round_trip: whether the decoded ids give the text again.

    A null text has null ids, no tokens and counts as a round trip. Marks in a text come back as
    blanks, the one loss of this scheme; the comparison allows for it.
    """
    path = model or default_model()
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]

    def run(texts: list) -> list[list]:
        v = vocabulary(path)
        rows: list[bytes | None] = []
        for at in range(0, len(texts), SLICE):
            rows += v.packed(texts[at : at + SLICE])
        same = [x is None or v.decode(np.frombuffer(p, np.int32).tolist()) == x.replace(MARK, " ") for x, p in zip(texts, rows)]
        return [_arrow(rows), [len(p or b"") // 4 for p in rows], same]

    return append(df, text_col, fields, run)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to the same text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "round_trip", "ids")


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All columns of documents, their ids, token counts and round trip."""
    return round_trip(docs)


QUERIES = {"op10_pieces": op10_pieces}
ORACLES: dict[str, str] = {}
