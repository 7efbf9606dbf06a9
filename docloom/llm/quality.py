"""Quality rules: gradient-boosted trees over document statistics.

Base rules reject very short and very repetitive texts. The other verdict is that of boosted trees
with monotonic constraints on chosen statistics, flattened into numpy node arrays so that a batch
of documents is scored by a few vectorised steps, one for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import append, freed, table, tune

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that trees split on, and the direction in which each may move the quality (0: either).
STATISTICS = {
    "log_words": 0, "mean_word": 0, "longest_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "punct_share": 0, "distinct_share": 0, "words_a_line": 0, "wide_share": 0,
}
CONSTRAINTS = np.array(list(STATISTICS.values()))
_UPPER, _DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[33, 44, 46, 58, 59, 63]] = True


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    first: dict[bytes, int] = {}
    w = np.array([first.setdefault(x, len(first)) for x in words], dtype=np.int64)
    if len(first) == len(words):
        return 0
    v = len(first)
    pair = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1].reshape(-1)
    four = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1].reshape(-1)
    _, five, counts = np.unique(four[:m] * v + w[4:], return_inverse=True, return_counts=True)
    again = counts[five.reshape(-1)] > 1
    if not again.any():
        return 0
    step = np.zeros(len(words) + 1, dtype=np.int64)
    step[:m] += again
    step[WINDOW : WINDOW + m] -= again
    return int((np.cumsum(step[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts and the statistics of a whole text (null: as an empty one)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(STATISTICS)
    chars = len(text) - len(raw) + len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, size = max(1, by[_LETTER].sum()), max(1, chars)
    more = [
        np.log1p(n), chars / n, max(map(len, words)), symbols / size, dup / len(lines), repeat / n,
        by[_UPPER].sum() / letters, by[_DIGIT].sum() / size, by[_PUNCT].sum() / size, len(set(words)) / n, n / len(lines), by[128:].sum() / size,
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in more]


def fails(base: list[int]) -> bool:
    return base[0] < 10 or 100 * base[4] > 20 * base[0]


@dataclass
class Trees:
    """All trees in flat arrays: node i of tree t is at roots[t] + i; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of statistics."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def constant(p: float) -> Trees:
    one = np.zeros(1, np.int64)
    return Trees(one, np.zeros(1), one, one, np.zeros(1), one, 0, float(np.log(p / (1 - p))))


def train(x: np.ndarray, y: np.ndarray, constraints: np.ndarray = CONSTRAINTS, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, reg: float = 2.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on binned statistics.

    A split on a constrained statistic is taken only if its children's values keep the direction,
    and the values below each side stay on that side of the split's middle.
    """
    if not len(y) or y.min() == y.max():
        return constant(0.999 if not len(y) or y[0] else 0.001)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), start)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        todo = [(len(nodes) - 1, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, lo, hi = todo.pop()
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + reg), lo, hi))
            best = _split(code[rows], g[rows], h[rows], edges, constraints, lo, hi, reg, least) if level < depth and len(rows) > 1 else None
            if best is None:
                nodes[at] = [0, 0.0, at, at, rate * value]
                f[rows] += rate * value
                continue
            j, k, wl, wr = best
            go = code[rows, j] <= k
            left = len(nodes)
            nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
            nodes[at] = [j, float(edges[j][k]), left, left + 1, 0.0]
            mid, c = (wl + wr) / 2, constraints[j]
            todo.append((left, rows[go], level + 1, mid if c < 0 else lo, mid if c > 0 else hi))
            todo.append((left + 1, rows[~go], level + 1, mid if c > 0 else lo, mid if c < 0 else hi))
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots), depth, start)


def _split(code, g, h, edges, constraints, lo, hi, reg, least):
    best, gain = None, 1e-6
    total_g, total_h = g.sum(), h.sum()
    base = total_g**2 / (total_h + reg)
    for j, e in enumerate(edges):
        if not len(e):
            continue
        gl = np.cumsum(np.bincount(code[:, j], g, len(e) + 1))[:-1]
        hl = np.cumsum(np.bincount(code[:, j], h, len(e) + 1))[:-1]
        gr, hr = total_g - gl, total_h - hl
        wl, wr = np.clip(-gl / (hl + reg), lo, hi), np.clip(-gr / (hr + reg), lo, hi)
        won = gl**2 / (hl + reg) + gr**2 / (hr + reg) - base
        won[(hl < least) | (hr < least) | (constraints[j] * (wr - wl) < 0)] = 0
        k = int(won.argmax())
        if won[k] > gain:
            best, gain = (j, k, float(wl[k]), float(wr[k])), won[k]
    return best


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 6000) -> Trees:
    """Fit on a bounded sample: the ``max_rows`` labelled rows of least hashed id.

    Labels of null id or value, and those whose document is missing, teach nothing; of one id's
    repeated labels the least counts. Documents that fail the base rules are left out, as they are
    rejected anyway. Without both kinds of label the verdict is constant.
    """
    tune(docs.sparkSession)
    lab = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    lab = lab.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(x) for x in b.column(2).to_pylist()]
            ok = [i for i, (base, _) in enumerate(got) if not fails(base)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok, pa.int64())), b.column(1).take(pa.array(ok, pa.int64())), pa.array([got[i][1] for i in ok], pa.list_(pa.float64()))], names=["id", "y", "x"])

    out = rows.mapInArrow(freed(run), T.StructType([rows.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])).collect()
    out.sort(key=lambda r: r["id"])
    return train(np.array([r["x"] for r in out]).reshape(len(out), len(STATISTICS)), np.array([r["y"] for r in out], dtype=float))


def judge(df: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """All columns, the base counts, base_failed, quality (the trees' probability) and kept.

    A document is kept if it passes the base rules and its probability is ``least`` or more: below
    one half, so that doubtful documents stay. A null or empty text has no words, and so fails.
    Texts of any length are judged whole, equal texts alike; an empty table gives no rows. A column
    that has the name of a new one, in whatever case, is replaced; further columns are kept.
    """
    fields = [*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def run(texts: list) -> list[list]:
        got = [statistics(x) for x in texts]
        p = trees.score(np.array([x for _, x in got]).reshape(len(got), len(STATISTICS)))
        failed = [fails(base) for base, _ in got]
        return [*map(list, zip(*(base for base, _ in got))), failed, p.tolist(), [not f and q >= least for f, q in zip(failed, p.tolist())]] if got else [[] for _ in fields]

    return append(df, text_col, fields, run)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
