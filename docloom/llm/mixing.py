"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised. The exponent is bisected: it
is the largest that reaches a target entropy, or the least that a limit on repetition allows if that
is larger. Weights times a token budget give each source's tokens; they are realised as whole
epochs and a part of one more. An epoch is a permutation: its blocks follow one another by a seeded
hash, and documents in a block by another; the part of an epoch is a prefix of that order. Every draw
carries its place (epoch, block key, document key), so that a sort by them delivers the permutation,
and a document's copies follow from a few numbers of its source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, exp, log

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, cut, table

#: Sources whose few numbers go to the driver and are broadcast at most; beyond it, sums and joins over sources stay in Spark.
MOST_SOURCES = 100_000
#: Documents of a block on average.
BLOCK_DOCS = 1024
#: Hexadecimal digits of block keys by which the end of a part epoch is sought first: so many parts at most meet in one task, however many blocks there are.
DIGITS = 3
PLACE = ("mix_epoch", "mix_block", "mix_key")


@dataclass
class Mixture:
    """Weights, repetitions and the exponent of a mixture; lists run as ``sources`` and are empty where those are too many for the driver."""

    sources: list
    tokens: list[int]
    weights: list[float]
    exponent: float
    budget: int

    @property
    def repeats(self) -> list[float]:
        return [w * self.budget / t if t else 0.0 for w, t in zip(self.weights, self.tokens)]


@dataclass
class Shares:
    """What the exponent depends on: sources with tokens, all tokens, the least and largest source, and sums over the shares s of s^a and of s^a ln s."""

    live: int
    total: int
    least: int
    largest: int
    sums: Callable[[float], tuple[float, float]]


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Token shares to the power of the exponent, normalised; sources without tokens weigh nothing."""
    total = sum(tokens)
    top = [exp(exponent * log(t / total)) if t else 0.0 for t in tokens]
    return [x / sum(top) for x in top] if total else [0.0] * len(tokens)


def entropy(p: list[float]) -> float:
    return -sum(x * log(x) for x in p if x > 0)


def bisect(x: Shares, target_entropy: float | None, most_repeats: float | None, budget: int | None) -> tuple[float, int]:
    """Exponent in [0, 1] and budget.

    ``target_entropy`` is a part of the largest one, the logarithm of the number of sources. Entropy
    falls and the most repeated source (the least one) repeats less as the exponent grows. If the shares
    as they are have that entropy, they stay; if no exponent keeps the limit, they stay as well. Without a
    budget, it is the least by which every source is seen whole.
    """
    if not x.live:
        return 1.0, budget or 0

    def entropy_at(a: float) -> float:
        s0, s1 = x.sums(a)
        return log(s0) - a * s1 / s0

    def tokens(a: float, s0: float) -> float:  # the largest source has the least repeats
        return budget if budget is not None else x.total * s0 * (x.largest / x.total) ** (1 - a)

    def repeats(a: float) -> float:
        s0 = x.sums(a)[0]
        return tokens(a, s0) / x.total * (x.least / x.total) ** (a - 1) / s0

    def search(fine: Callable[[float], bool]) -> float:  # fine holds from some exponent up to 1
        lo, hi = 0.0, 1.0
        if fine(lo):
            return lo
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fine(mid) else (mid, hi)
        return hi

    a = 1.0
    if x.live > 1 and target_entropy is not None:
        goal = target_entropy * log(x.live)
        a = 1.0 if entropy_at(1.0) >= goal else search(lambda e: entropy_at(e) <= goal)
    elif x.live > 1:
        a = 0.0
    if x.live > 1 and most_repeats is not None:
        a = max(a, search(lambda e: repeats(e) <= most_repeats))
    return a, ceil(tokens(a, x.sums(a)[0]) - 1e-6)


def solve(sources: list, tokens: list[int], target_entropy: float | None = None, most_repeats: float | None = None, budget: int | None = None) -> Mixture:
    """The mixture of sources with so many tokens; see ``bisect``."""
    live = [t for t in tokens if t]
    total = sum(live)

    def sums(a: float) -> tuple[float, float]:
        each = [(exp(a * log(t / total)), log(t / total)) for t in live]
        return sum(p for p, _ in each), sum(p * s for p, s in each)

    a, tokens_ = bisect(Shares(len(live), total, min(live, default=0), max(live, default=0), sums), target_entropy, most_repeats, budget)
    return Mixture(sources, tokens, weights(tokens, a), a, tokens_)


def _solve_in_spark(sizes: DataFrame, target_entropy: float | None, most_repeats: float | None, budget: int | None) -> Mixture:
    """The same for sources that are too many for the driver: each sum is one small job."""
    live = sizes.filter("n > 0")
    r = live.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    s = F.col("n") / F.lit(float(r["n"]))

    def sums(a: float) -> tuple[float, float]:
        return tuple(live.agg(F.sum(F.pow(s, F.lit(a))), F.sum(F.pow(s, F.lit(a)) * F.log(s))).first())

    a, tokens = bisect(Shares(r["k"], r["n"], r["a"] or 0, r["b"] or 0, sums), target_entropy, most_repeats, budget)
    return Mixture([], [], [], a, tokens)


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\\N")) if isinstance(p, Column) else F.lit(p) for p in parts]))


def _block(ident: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(ident, F.lit(f"b{seed}")), blocks)


def _block_key(seed: int, source: Column, epoch: Column, block: Column) -> Column:
    return _key(f"e{seed}", source, epoch, block)


def _doc_key(seed: int, epoch: Column, ident: Column) -> Column:
    return _key(f"d{seed}", epoch, ident)


def _ident(id_col: str, text_col: str) -> Column:
    """Rows of one id and one text are drawn alike; null ids are told apart by their texts."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))


def _few(number: int, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if number <= MOST_SOURCES else df


def plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", target_entropy: float | None = 0.98, most_repeats: float | None = 2.0, budget: int | None = None, seed: int = 1) -> tuple[Mixture, DataFrame]:
    """The mixture, and for each source: source, epochs, blocks, edge (key of the block where the last epoch ends), edge_block and last (key of its last document).

    Texts are read once: words are counted into a narrow table. A null source is a source of its own. The
    end of a part epoch is found by the first digits of block keys, then among the blocks of those, then
    among the documents of one block.
    """
    n = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    d = cut(docs.select(_ident(id_col, text_col).alias("ident"), F.col(f"`{source_col}`").cast("string").alias("source"), n.alias("n")), "mixing-counts")
    sizes = cut(d.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "mixing-sources")
    number = sizes.count()
    if number <= MOST_SOURCES:
        rows = sorted(sizes.collect(), key=lambda r: (r["source"] is not None, r["source"] or ""))
        mix = solve([r["source"] for r in rows], [r["n"] for r in rows], target_entropy, most_repeats, budget)
    else:
        mix = _solve_in_spark(sizes, target_entropy, most_repeats, budget)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).first()["n"]
    power = F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(total), F.lit(mix.exponent))).otherwise(F.lit(0.0))
    norm = sizes.agg(F.coalesce(F.sum(power), F.lit(0.0))).first()[0]
    share = F.round(power / F.lit(norm or 1.0) * F.lit(float(mix.budget))).cast("long")
    params = sizes.withColumn("share", share).withColumn("epochs", F.when(F.col("n") > 0, F.expr("share div n")).otherwise(F.lit(1)).cast("long"))
    params = params.withColumn("rest", F.when(F.col("n") > 0, F.col("share") - F.col("epochs") * F.col("n")).otherwise(F.lit(0)).cast("long"))
    params = cut(params.select("source", "epochs", "rest", F.ceil(F.col("docs") / BLOCK_DOCS).cast("long").alias("blocks")), "mixing-params")

    def at(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        right = _few(number, right.select(*[F.col(c).alias(f"r_{c}" if c in ("source", *keys) else c) for c in right.columns]))
        same = F.col("source").eqNullSafe(F.col("r_source"))
        for k in keys:
            same = same & (F.col(k) == F.col(f"r_{k}"))
        return left.join(right, same).drop("r_source", *[f"r_{k}" for k in keys])

    def ends(parts: DataFrame, *order: str) -> DataFrame:
        """Of each source's parts (n tokens each) the one where ``left`` tokens end, and what of them is left there."""
        up_to = F.sum("n").over(Window.partitionBy("source").orderBy(*order))
        return parts.withColumn("left", F.col("left") - (up_to - F.col("n"))).filter((F.col("left") >= 0) & (F.col("left") < F.col("n"))).drop("n")

    e = at(d, params.filter("rest > 0")).withColumn("block", _block(F.col("ident"), F.col("blocks"), seed))
    e = e.withColumn("edge", _block_key(seed, F.col("source"), F.col("epochs"), F.col("block"))).withColumn("digits", F.substring("edge", 1, DIGITS))
    first = cut(ends(e.groupBy("source", "digits").agg(F.sum("n").alias("n"), F.first("rest").alias("left")), "digits"), "mixing-digits")
    inside = at(e, first, "digits")
    block = cut(ends(inside.groupBy("source", "edge", "block").agg(F.sum("n").alias("n"), F.first("left").alias("left")), "edge", "block"), "mixing-edges")
    inside = at(e, block.withColumnRenamed("edge", "at"), "block").withColumn("key", _doc_key(seed, F.col("epochs"), F.col("ident")))
    each = inside.groupBy("source", "key").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("key"))
    last = each.withColumn("sum", run).filter(F.col("sum") <= F.col("left")).groupBy("source").agg(F.max("key").alias("last"))
    out = params
    for part in (block.select("source", "edge", F.col("block").alias("edge_block")), last):
        p = _few(number, part.withColumnRenamed("source", "r_source"))
        out = out.join(p, F.col("source").eqNullSafe(F.col("r_source")), "left").drop("r_source")
    out = out.select("source", "epochs", "blocks", F.coalesce("edge", F.lit("")).alias("edge"), F.coalesce("edge_block", F.lit(-1)).alias("edge_block"), F.coalesce("last", F.lit("")).alias("last"))
    return mix, cut(out, "mixing-plan")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 1, **targets) -> DataFrame:
    """All columns, mix_epoch (from 0), mix_block and mix_key (its place), a row for each time that a document is drawn.

    A document of a source with a part of an epoch left is in it if its block comes before the one
    where the tokens end, or in that one and not behind its last document; the document that would
    pass the budget stays out. Documents without words (null and empty texts) come as often as their
    source's others but are free of charge; a source without any words comes once. Rows that repeat an id
    and a text are drawn alike and have one place. A text of any length counts whole. Columns with the
    names of the place are replaced. An empty table gives none.
    """
    mixture, params = plan(docs, text_col, source_col, id_col, seed=seed, **targets)
    p = params.select(*[F.col(c).alias(f"__{c}") for c in params.columns])
    d = docs.join(_few(len(mixture.sources) or MOST_SOURCES + 1, p), F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__source")))
    d = d.withColumn("__ident", _ident(id_col, text_col)).withColumn("__block", _block(F.col("__ident"), F.col("__blocks"), seed))
    key = _block_key(seed, F.col("__source"), F.col("__epochs"), F.col("__block"))
    more = (key < F.col("__edge")) | ((F.col("__block") == F.col("__edge_block")) & (_doc_key(seed, F.col("__epochs"), F.col("__ident")) <= F.col("__last")))
    d = d.withColumn("__copies", (F.col("__epochs") + more.cast("long")).cast("int")).filter("__copies > 0")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in PLACE]
    d = d.select(*kept, "__source", "__block", "__ident", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("mix_epoch"))
    return d.select(*kept, "mix_epoch", _block_key(seed, F.col("__source"), F.col("mix_epoch"), F.col("__block")).alias("mix_block"), _doc_key(seed, F.col("mix_epoch"), F.col("__ident")).alias("mix_key"))


def arranged(draws: DataFrame) -> DataFrame:
    """Draws in the order of the permutation: epoch after epoch, blocks of all sources mixed, documents mixed in their blocks."""
    return draws.orderBy(*PLACE)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of every document, with its place: sources evened out to the largest entropy as far as none comes more than twice over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, target_entropy=1.0, most_repeats=2.0).select("doc_id", "source", *PLACE)


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents as often as the mixture draws them: each at least once, none more than twice; see ``mix`` for odd rows."""
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
