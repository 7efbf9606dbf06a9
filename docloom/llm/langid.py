"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties, then a temperature is
fitted on rows kept aside. Features are hashed character 1- to 3-grams of the lower-cased text;
a gram's weight is its share of the text's grams times its inverse document frequency. A
prediction is therefore a mean of table look-ups over all grams of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import append, fold, freed, table, tune

BITS = 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Characters handled at once; a longer text is handled in slices of this size.
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_MULT = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
SCALE = 100.0


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two blanks."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams that start at each of the first len - n + 1 places."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(m, n * 40503, dtype=np.uint32)
    for k in range(n):
        h ^= codes[k : k + m] * _MULT[k]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their term frequencies (they sum to 1)."""
    codes, counts = _codes(text), np.zeros(1 << BITS)
    for n in ORDERS:
        for at in range(0, len(codes), CHUNK):
            counts += np.bincount(_grams(codes[at : at + CHUNK + n - 1], n), minlength=1 << BITS)
    idx = np.flatnonzero(counts)
    return idx.astype(np.int32), (counts[idx] / counts.sum()).astype(np.float32)


def buckets(text: str) -> np.ndarray:
    """Distinct buckets of a whole text."""
    codes, seen = _codes(text), np.zeros(1 << BITS, bool)
    for n in ORDERS:
        for at in range(0, len(codes), CHUNK):
            seen[_grams(codes[at : at + CHUNK + n - 1], n)] = True
    return np.flatnonzero(seen)


@dataclass
class LanguageModel:
    """Learned languages, a table of log-odds by bucket and language, and the temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        group: list[int] = []
        parts: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(texts):
            codes = _codes(text)
            group.append(i)
            parts.append(codes)
            size += len(codes)
            if size >= CHUNK or i + 1 == len(texts):
                out[group] += self._means(parts)
                group, parts, size = [], [], 0
        return out

    def _means(self, parts: list[np.ndarray]) -> np.ndarray:
        sums = np.zeros((len(parts), len(self.langs)))
        lens = np.array([len(p) for p in parts])
        total = sum(np.maximum(lens - n + 1, 0) for n in ORDERS)
        codes = np.concatenate(parts)
        ends = np.cumsum(lens)
        owner = np.repeat(np.arange(len(parts)), lens)
        for n in ORDERS:
            for at in range(0, len(codes), CHUNK):
                idx = _grams(codes[at : at + CHUNK + n - 1], n)
                own = owner[at : at + len(idx)]
                inside = np.arange(at, at + len(idx)) + n <= ends[own]
                idx, own = idx[inside], own[inside]
                if not len(own):
                    continue
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                for k in range(len(self.langs)):
                    sums[own[first], k] += np.add.reduceat(self.weights[k][idx], first, dtype=np.float64)
        return sums / total[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        live = [i for i, x in enumerate(texts) if x and _LETTER.search(x)]
        if live and self.langs:
            p = softmax(self.logits([texts[i] for i in live]) / self.temperature)
            for i, k, best in zip(live, p.argmax(1).tolist(), p.max(1).tolist()):
                lang[i], score[i] = self.langs[k], best
        return lang, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_langs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial FTRL-proximal. rows: (class, buckets, values). Returns weights (buckets x classes) and biases."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, n_langs)), np.zeros((size + 1, n_langs))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, idx, val = rows[r]
            idx, val = np.append(idx, size), np.append(val, 1.0)
            zi, ni = z[idx], n[idx]
            w = _weights(zi, ni, alpha, beta, l1, l2)
            g = softmax(val @ w)
            g[y] -= 1.0
            g = val[:, None] * g[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
    w = _weights(z, n, alpha, beta, l1, l2)
    return w[:size], w[size]


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all texts with a letter each bucket occurs, and the number of these texts; one count for each bucket and task is shuffled."""

    def run(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                if x and _LETTER.search(x):
                    seen[buckets(x)] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], names=["bucket", "n"])

    got = docs.select(F.col(f"`{text_col}`")).mapInArrow(freed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = dict(zip(got.column("bucket").to_pylist(), got.column("n").to_pylist()))
    total = out.pop(-1, 0)
    df = np.zeros(1 << BITS)
    df[list(out)] = list(out.values())
    return df, total


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 1600) -> LanguageModel:
    """Fit on a bounded sample of labelled rows; document frequencies are those of all of them.

    ``max_rows`` bounds the rows fitted, dealt evenly over all languages (four of each, if there are more
    languages than that allows). Rows are chosen by a hash of the id, ties by the id, so a run repeats; of rows
    that repeat an id all or none are chosen. Rows with a null text, lang or id, or without a letter, teach
    nothing. Long texts count whole. Without rows, the model knows no language and predicts ``und``. The model
    has 2^15 weights a language.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").alias("id")).filter("text is not null and lang is not null and id is not null")
    counts = docs.groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0)
    each = max(4, max_rows // len(counts))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * (each + 20) / r["count"])) for r in counts], "lang string, rate double")
    u = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = docs.select("id", "lang", u.alias("u")).join(F.broadcast(rates), "lang").filter("u < rate")
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "id"))).filter(F.col("k") <= each).select("id", "lang")
    picked = chosen.collect()
    ids = docs.sparkSession.createDataFrame([(r["id"],) for r in picked], T.StructType([T.StructField("id", docs.schema["id"].dataType)]))
    sample = docs.join(F.broadcast(ids.distinct()), "id").select("id", "text", "lang")

    def run(batches):
        for b in batches:
            kept = [(i, x, y, features(x)) for i, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if _LETTER.search(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in kept], b.schema.field(0).type), pa.array([r[2] for r in kept], pa.string()), pa.array([r[3][0] for r in kept], pa.list_(pa.int32())), pa.array([r[3][1] for r in kept], pa.list_(pa.float32()))],
                names=["id", "lang", "idx", "tf"],
            )

    got = sample.mapInArrow(freed(run), T.StructType([T.StructField("id", docs.schema["id"].dataType), *T._parse_datatype_string("lang string, idx array<int>, tf array<float>").fields])).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0)
    df, total = frequencies(docs, "text")
    idf = np.log((1 + total) / (1 + df)) + 1
    idx, tf, lang = got.column("idx").combine_chunks(), got.column("tf").combine_chunks(), got.column("lang").to_pylist()
    place = {x: i for i, x in enumerate(langs)}
    rows = []
    for i in np.argsort(np.array(got.column("id").to_pylist()), kind="stable").tolist():
        a = idx[i].values.to_numpy()
        rows.append((place[lang[i]], a, tf[i].values.to_numpy().astype(np.float64) * idf[a] * SCALE))
    mine = [r for i, r in enumerate(rows) if i % 5] or rows
    aside = [r for i, r in enumerate(rows) if i % 5 == 0]
    w, bias = train_ftrl(mine, len(langs))
    logits = np.array([v @ w[a] + bias for _, a, v in aside])
    t = fit_temperature(logits, np.array([r[0] for r in aside]))
    return LanguageModel(langs, np.ascontiguousarray((w * idf[:, None] * SCALE).T.astype(np.float32)), bias, t)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns, the predicted language and its calibrated probability.

    A null text, an empty one or one without any letter gets ``und`` and 0.0; of equal probabilities the language
    that sorts first is taken. A text of any length is read whole, in slices. Repeated rows get the same
    prediction; columns with the names of the new ones are replaced; an empty table gives no rows.
    """
    fields = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
    return append(df, text_col, fields, lambda texts: list(model.predict(texts)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of documents, learned from the rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents whose language is known with a probability of ``least`` or more; see ``predict`` for odd rows (null and empty texts go)."""
    held = docs.filter(fold("doc_id", 4) != 2)
    out = predict(docs, fit(held), lang_out="__lang", score_out="__score")
    return out.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
