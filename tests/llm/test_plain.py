"""Plain versions of whole verdicts: boosting by loops over rows and thresholds, and links at the edge of the similarity."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import minhash, quality
from tests.conftest import DATA

RATE, REG, LEAST, TREES, DEPTH = 0.15, 2.0, 1.0, 60, 4


def plain_statistics(x):
    """The statistics of a text, one character and word at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    if not words:
        return [0.0] * len(quality.STATISTICS)
    n, sizes = len(words), [len(w.encode()) for w in words]
    chars = sum(map(len, words))
    lines = [y.encode() for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    data = x.encode()
    letters = max(1, sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in data))
    return [
        math.log1p(n), chars / n, max(sizes), sum(c in "#*$%&|<>" for c in x) / chars, (len(lines) - len(set(lines))) / len(lines), len(again) / n,
        sum(65 <= b <= 90 for b in data) / letters, sum(48 <= b <= 57 for b in data) / chars, sum(chr(b) in "!,.:;?" for b in data) / chars, len(set(words)) / n, n / len(lines), sum(b >= 128 for b in data) / chars,
    ]


def plain_trees(xs, ys, constraints, n_trees=TREES, depth=DEPTH, bins=48):
    """Trees as nested tuples: a leaf is its value; a split is (statistic, threshold, below, above)."""
    edges = [np.unique(np.quantile(np.array([x[j] for x in xs]), np.linspace(0, 1, bins + 1)[1:-1])).tolist() for j in range(len(xs[0]))]
    start = math.log(sum(ys) / len(ys) / (1 - sum(ys) / len(ys)))
    score = [start] * len(ys)

    def grow(rows, level, lo, hi, g, h):
        clip = lambda v: min(max(v, lo), hi)
        tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        if level < depth and len(rows) > 1:
            top = 1e-6
            for j, e in enumerate(edges):
                mine, k_best = None, 0.0
                for k, t in enumerate(e):
                    gl, hl = sum(g[i] for i in rows if xs[i][j] <= t), sum(h[i] for i in rows if xs[i][j] <= t)
                    gr, hr = tg - gl, th - hl
                    wl, wr = clip(-gl / (hl + REG)), clip(-gr / (hr + REG))
                    won = gl**2 / (hl + REG) + gr**2 / (hr + REG) - tg**2 / (th + REG)
                    if hl < LEAST or hr < LEAST or constraints[j] * (wr - wl) < 0:
                        won = 0
                    if won > k_best + 1e-9:
                        mine, k_best = (j, t, wl, wr), won
                if mine and k_best > top + 1e-9:
                    best, top = mine, k_best
        if best is None:
            v = RATE * clip(-tg / (th + REG))
            for i in rows:
                score[i] += v
            return v
        j, t, wl, wr = best
        mid, c = (wl + wr) / 2, constraints[j]
        below, above = [i for i in rows if xs[i][j] <= t], [i for i in rows if xs[i][j] > t]
        return (j, t, grow(below, level + 1, mid if c < 0 else lo, mid if c > 0 else hi, g, h), grow(above, level + 1, mid if c > 0 else lo, mid if c < 0 else hi, g, h))

    out = []
    for _ in range(n_trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        out.append(grow(list(range(len(ys))), 0, -math.inf, math.inf, [a - b for a, b in zip(p, ys)], [max(a * (1 - a), 1e-6) for a in p]))
    return start, out


def plain_score(start, trees, x):
    total = start
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        total += t
    return 1 / (1 + math.exp(-total))


def test_boosting_equals_plain_loops_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.random((60, 4))
    y = (x[:, 0] - x[:, 1] + 0.4 * rng.standard_normal(60) > 0).astype(float)
    constraints = np.array([1, -1, 0, 0])
    trees = quality.train(x, y, constraints, n_trees=12)
    start, plain = plain_trees(x.tolist(), y.tolist(), constraints.tolist(), 12)

    def same(at, t):
        if isinstance(t, tuple):
            assert (trees.feature[at], trees.left[at] != at) == (t[0], True) and abs(trees.threshold[at] - t[1]) < 1e-12
            same(trees.left[at], t[2])
            same(trees.right[at], t[3])
        else:
            assert trees.left[at] == at and abs(trees.value[at] - t) < 1e-9

    assert abs(trees.start - start) < 1e-12 and any(isinstance(t, tuple) for t in plain)
    for root, t in zip(trees.roots, plain):
        same(root, t)


def test_quality_verdicts_equal_plain_ones(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{DATA}/labels.parquet").collect():
        labels[r["doc_id"]] = min(labels.get(r["doc_id"], 9), r["quality"])
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, DATA).collect()}
    stats = {i: plain_statistics(x) for i, x in docs.items()}
    for i, x in docs.items():
        assert np.allclose(quality.statistics(x)[1], stats[i])
    taught = sorted(i for i in labels if i in docs and not got[i]["base_failed"])
    start, trees = plain_trees([quality.statistics(docs[i])[1] for i in taught], [float(labels[i]) for i in taught], quality.CONSTRAINTS.tolist())
    for i in docs:
        p = plain_score(start, trees, quality.statistics(docs[i])[1])
        assert abs(got[i]["quality"] - p) < 1e-6 and got[i]["kept"] == (not got[i]["base_failed"] and p >= 0.35)


def test_no_link_is_lost_at_the_edge_of_the_similarity(spark):
    """Pairs whose sets agree in 0.80 to 0.82 of their union, of many sizes, and pairs just below: all of the first are linked and none of the others."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, want = [], {}
    for k in range(400):
        n = rng.choice([30, 60, 120, 400, 1500])
        a = [word() for _ in range(n + 3)]  # n shingles
        target = rng.uniform(0.80, 0.82) if k % 2 == 0 else rng.uniform(0.77, 0.7999)
        keep = int(round(2 * n * target / (1 + target)))  # shingles in common, if b keeps a run of them and replaces the rest
        b = a[: keep + 3] + [word() for _ in range(n - keep)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k + 1] = 2 * k if 100 * keep >= 80 * (2 * n - keep) else 2 * k + 1
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).filter(F.col("doc_id") % 2 == 1).collect()}
    assert got == want and sum(i != c for i, c in want.items()) > 150
