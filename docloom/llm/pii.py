"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Runs of tokens that hold a digit are the instances. Seeds are the runs that meet a base span (emails,
addresses, cards, phones) or have the shape of a generated secret. The two words before a run and the
two behind it are its lexical patterns; words go across lines, and the text's start and end and other
runs stand as words of their own. Patterns and instances form a graph. A pattern's support is the
summed score of its distinct instances: one for a seed, and for any other what the other trusted
patterns give that it stands in. Instances without a score are unknown and count neither way. A
pattern is trusted if it has enough support, more of it than chance gives to other patterns, and is
specific: a large part of all its occurrences in the corpus stand at an instance. Rounds spread trust
until it stands still. Runs at trusted patterns are new spans of kind ``context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, table

# Kinds in their order and their patterns. Quantifiers are possessive and starts are
# bound by look-behind where that changes no match, so that long tokens take linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?+[0-9]){13}", "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = "context"
_BLANK = r"\x20\x09-\x0D"
#: A run is a token with a digit, or several that have digits but no letters.
_PLAIN = rf"[^{_BLANK}0-9\p{{L}}]*+[0-9][^{_BLANK}\p{{L}}]*+(?![^{_BLANK}])"
RUN = rf"(?<![^{_BLANK}])(?:{_PLAIN}(?:[\x20\x09]{_PLAIN})*+|[^{_BLANK}0-9]*+[0-9][^{_BLANK}]*+)"
_EDGE = ".,;:!?\"'()[]{}<>#*|$%&~`"
#: What lies between the words of a pattern: blanks and punctuation.
_BETWEEN = r"[\x20\x09-\x0D.,;:!?\x22'()\[\]{}<>#*|$%&~`]+"
#: Words that stand for the text's start, a run, and the text's end.
START, MARK, END = "\ue001", "\ue000", "\ue002"
#: Shapes of generated secrets (digests and keys in hexadecimal, identifiers in five groups, long keys of mixed characters).
SECRET = r"^(?:[0-9a-fA-F]{32,}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=(?:[^0-9]*[0-9]){3})[A-Za-z0-9+/_-]{20,}={0,2})$"
#: A run is an identifier if it has so many characters and digits.
LEAST_CHARS, LEAST_DIGITS = 6, 3
#: A trusted pattern has such a support, and such a share of its occurrences at instances; its share of supported instances is surely above that of
#: all other patterns, or above CHANCE where that is larger. Z is the square of the normal deviate of a 95 % interval.
SEEDS, SPECIFIC, CHANCE, Z = 8, 0.3, 0.25, 1.96**2
#: Pairs of words that are picked out while all are read, at most.
FEW = 20_000
#: Supports stand still if their sum (of logarithms) changes by no larger part.
STILL = 1e-4
#: Items that are folded into one array before the arrays are joined: appending to one array alone would take quadratic time.
FOLD = 1000

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(x: Column, fn) -> Column:
    """fn(x) with x computed once, however often fn names it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def _fold(items: Column, state: Column, kind: str, step) -> Column:
    """Array of what ``step`` gives for each item: step(state, item) is a struct of state and one; state goes from item to item."""
    empty = lambda k: F.array().cast(f"array<{k}>")

    def inner(a, x):
        return _let(step(a["state"], x), lambda got: F.struct(got["state"].alias("state"), F.array_append(a["out"], got["one"]).alias("out")))

    def outer(a, chunk):
        return F.aggregate(chunk, F.struct(a["state"].alias("state"), empty(kind).alias("out")), inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).alias("out")))

    def all_(x):
        chunks = F.transform(F.sequence(F.lit(0), (F.size(x) - 1).cast("int"), F.lit(FOLD)), lambda i: F.slice(x, i + 1, F.lit(FOLD)))
        out = F.aggregate(chunks, F.struct(state.alias("state"), empty(f"array<{kind}>").alias("out")), outer, lambda a: F.flatten(a["out"]))
        return F.when(F.size(x) > 0, out).otherwise(empty(kind))

    return _let(items, all_)


def _gaps(text: Column, pattern: str, fn) -> Column:
    """fn(found, gaps) of the matches and of what lies between, before and behind them."""
    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), lambda x: fn(x["found"], x["gaps"]))


def _places(text: Column, pattern: str) -> Column:
    """start, end and text of every match: lengths of matches and of what lies between add up to offsets."""
    kind = "struct<start:int,end:int,text:string>"

    def step(pos, x):
        start, end = pos + x["gap"], pos + x["gap"] + F.length(x["m"])
        return F.struct(end.alias("state"), F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")).alias("one"))

    def all_(found, gaps):
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
        return F.when(F.size(found) > 0, _fold(both, F.lit(0), kind, step)).otherwise(F.array().cast(f"array<{kind}>"))

    return _gaps(text, pattern, all_)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    part = lambda i: F.when((n - i) % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind: array of (start, kind, end), in code points; none for a null text."""
    return F.array_sort(F.concat(*[_spans(text, k, kind) for k, kind in enumerate(KINDS)]))


def _spans(text: Column, k: int, kind: str) -> Column:
    need = NEEDS[kind]
    there = text.contains(need) if len(need) == 1 else text.rlike(need)
    kept = F.filter(_places(text, PATTERNS[kind]), lambda x: _holds(kind, x["text"]))
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    return F.when(there, spans).otherwise(F.array().cast(_SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in (*KINDS, CONTEXT)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _near(gap: Column, last: bool) -> Column:
    """Words of a gap that hold its last two (or first two) or are all: most often those of its end tell."""
    part = F.right(gap, F.lit(100)) if last else F.substring(gap, 1, 100)
    return _let(words(part), lambda w: F.when((F.size(w) >= 3) | (F.length(gap) <= 100), w).otherwise(words(gap)))


_RUN = "struct<start:int,end:int,text:string,left:string,right:string>"


def runs(text: Column) -> Column:
    """Runs of digit tokens that may be identifiers: start, end, text (without punctuation at its ends) and the patterns before and behind it.

    Before the first run stand the marks of the text's start, and before others what came before. A run with too few words
    up to the next run has no pattern behind it.
    """
    def step(a, x):
        start = a["pos"] + F.length(x["gap"])
        core = F.trim(x["m"], F.lit(_EDGE))
        skip = F.length(x["m"]) - F.length(F.ltrim(x["m"], F.lit(_EDGE)))
        before = F.slice(F.concat(a["tail"], _near(x["gap"], True)), -2, 2)
        behind = F.concat(_near(x["next"], False), F.when(x["last"], F.array(F.lit(END), F.lit(END))).otherwise(F.array(F.lit(MARK))))
        pair = lambda side, w: F.when(F.size(w) >= 2, F.concat_ws(" ", F.lit(side), F.get(w, F.lit(0)), F.get(w, F.lit(1))))

        def put(v):
            one = F.struct((v["start"] + v["skip"]).alias("start"), (v["start"] + v["skip"] + F.length(v["core"])).alias("end"), v["core"].alias("text"), pair("<", v["before"]).alias("left"), pair(">", v["behind"]).alias("right"))
            return F.struct(F.struct((v["start"] + F.length(x["m"])).alias("pos"), F.array(F.get(v["before"], F.lit(1)), F.lit(MARK)).alias("tail")).alias("state"), one.alias("one"))

        return _let(F.struct(start.alias("start"), skip.alias("skip"), core.alias("core"), before.alias("before"), behind.alias("behind")), put)

    def all_(found, gaps):
        n = F.size(found)
        last = F.concat(F.array_repeat(F.lit(False), n - 1), F.array(F.lit(True)))
        around = F.zip_with(F.slice(gaps, F.lit(2), n), last, lambda gap, end: F.struct(gap.alias("next"), end.alias("last")))
        between = F.zip_with(F.slice(gaps, F.lit(1), n), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        items = F.zip_with(between, around, lambda a, b: F.struct(a["gap"].alias("gap"), a["m"].alias("m"), b["next"].alias("next"), b["last"].alias("last")))
        state = F.struct(F.lit(0).alias("pos"), F.array(F.lit(START), F.lit(START)).alias("tail"))
        return F.when(n > 0, _fold(items, state, _RUN, step)).otherwise(F.array().cast(f"array<{_RUN}>"))

    good = lambda x: (F.length(x["text"]) >= LEAST_CHARS) & (F.length(F.regexp_replace(x["text"], "[^0-9]", "")) >= LEAST_DIGITS)
    return F.when(text.rlike("[0-9]"), F.filter(_gaps(text, RUN, all_), good)).otherwise(F.array().cast(f"array<{_RUN}>"))


def _met(spans: Column, run: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < run["end"]) & (s["end"] > run["start"]))


def _scanned(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """Columns that are kept, mark (hash of the text), spans and runs of every row, written once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return cut(docs.select(*kept, F.xxhash64(text).alias("__mark"), base_spans(text).alias("__spans"), runs(text).alias("__runs")), "pii-scan")


def _sure(p: Column, n: Column) -> Column:
    """Lower end of the Wilson interval of a share p of n."""
    return (p + Z / (2 * n) - F.sqrt(Z * (F.greatest(p * (1 - p), F.lit(0.0)) / n + Z / (4 * n * n)))) / (1 + Z / n)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= 100_000 else df


def specific(edges: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Edges of those patterns of which such a share of all occurrences stand at instances.

    All pairs of neighbouring words of all texts are looked at, whatever their words: as hashes of 64 bits, of which those of patterns alone are
    counted where the patterns are few enough to travel; else all are counted, added up in each task first.
    """
    hashed = lambda x, y: F.xxhash64(x, y)
    before = edges.groupBy("pattern").agg(F.sum("n").alias("before")).withColumn("pair", F.expr("substring(pattern, 3)"))
    terms = cut(before.select("pattern", "before", F.split("pair", " ").alias("w")).select("pattern", "before", hashed(F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("h")), "pii-terms")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, RUN, f" {MARK} ")).otherwise(text)
    seqs = docs.select(F.split(F.concat(F.lit(f"{START} {START} "), F.lower(marked), F.lit(f" {END} {END}")), _BETWEEN).alias("w"))
    pairs = seqs.select(F.explode(F.zip_with("w", F.slice(F.col("w"), 2, 1 << 30), hashed)).alias("h"))
    asked = terms.select("h").distinct()
    if asked.count() <= FEW:
        pairs = pairs.filter(F.col("h").isin([r["h"] for r in asked.collect()]))
    total = pairs.groupBy("h").count()
    good = terms.join(total, "h").filter(F.col("before") >= SPECIFIC * F.col("count")).select("pattern")
    return cut(edges.join(_small(cut(good, "pii-specific")), "pattern", "left_semi"), "pii-good")


def trusted(scanned: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame | None:
    """Trusted patterns (pattern), or None if there is none."""
    r = scanned.filter(F.size("__runs") > 0).select("__spans", F.explode("__runs").alias("r"))
    seed = (_met(F.col("__spans"), F.col("r")) | F.col("r.text").rlike(SECRET)).cast("double")
    occ = r.select(F.explode(F.array("r.left", "r.right")).alias("pattern"), F.col("r.text").alias("instance"), seed.alias("seed")).filter("pattern is not null")
    edges = cut(occ.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-edges")
    whole = edges.agg(F.coalesce(F.sum("seed"), F.lit(0.0)).alias("seeds"), F.count("*").alias("all")).first()
    # Fewer distinct instances are no such support, whatever their scores.
    base = cut(edges.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count("*").alias("all")).filter(F.col("all") >= SEEDS), "pii-patterns")
    if base.filter(F.col("seeds") >= SEEDS).isEmpty():
        return None  # no pattern to begin with
    return spread(specific(edges.join(base.select("pattern", "all"), "pattern"), docs, text_col), whole["seeds"], whole["all"])


def spread(edges: DataFrame, seeds: float, n: int) -> DataFrame | None:
    """Trusted ones of the patterns of edges (pattern, instance, seed, and all: the pattern's instances), or None; seeds and n are those of the corpus.

    Rounds go on until no pattern becomes trusted and supports stand still: they only grow.
    """
    base = edges.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.first("all").alias("all"))
    rest = F.lit(n) - F.col("all")
    chance = F.least(F.lit(CHANCE), F.when(rest > 0, (F.lit(seeds) - F.col("seeds")) / F.greatest(rest, F.lit(1))).otherwise(0.0))
    base = base.select("pattern", "all", chance.alias("chance"))
    support, before, out = edges.groupBy("pattern").agg(F.sum("seed").alias("support")), None, None
    while True:
        s = F.col("support")
        good = base.join(support, "pattern").filter((s >= SEEDS) & (_sure(F.least(s / F.col("all"), F.lit(1.0)), F.col("all")) > F.col("chance")))
        out = cut(good.select("pattern", F.log(Z / (s + Z)).alias("doubt")), "pii-trusted")
        now = out.agg(F.count("*"), F.coalesce(F.sum("doubt"), F.lit(0.0))).first()
        if now[0] == 0:
            return None
        if before and now[0] == before[0] and abs(now[1] - before[1]) <= STILL * abs(now[1]):
            return out.select("pattern")
        before = now
        # An instance has the doubts of all trusted patterns that it stands in; it supports a pattern by those of the others alone.
        own = edges.join(_small(out), "pattern", "left").select("pattern", "instance", "seed", F.coalesce("doubt", F.lit(0.0)).alias("own"))
        all_ = own.filter("own < 0").groupBy("instance").agg(F.sum("own").alias("doubt"))
        score = F.greatest("seed", 1 - F.exp(F.least(F.coalesce("doubt", F.lit(0.0)) - F.col("own"), F.lit(0.0))))
        support = own.join(all_, "instance", "left").groupBy("pattern").agg(F.sum(score).alias("support"))


def discovered(scanned: DataFrame, patterns: DataFrame, id_col: str) -> DataFrame:
    """more_id, more_mark and added spans (more) of the documents that have runs at trusted patterns; runs that meet a base span add none."""
    r = scanned.filter(F.size("__runs") > 0).select(F.col(f"`{id_col}`").alias("more_id"), F.col("__mark").alias("more_mark"), "__spans", F.explode("__runs").alias("r")).filter(~_met(F.col("__spans"), F.col("r")))
    s = F.struct(F.col("r.start").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("r.end").alias("end"))
    r = r.select("more_id", "more_mark", s.alias("s"), F.explode(F.array("r.left", "r.right")).alias("pattern"))
    return r.join(patterns, "pattern", "left_semi").groupBy("more_id", "more_mark").agg(F.array_sort(F.collect_set("s")).alias("__more"))


def _all_spans(docs: DataFrame, text_col: str, id_col: str, *kept: Column) -> DataFrame:
    """Columns that are kept, __spans, and __all: base spans and added ones."""
    s = _scanned(docs, text_col, *kept)
    patterns = trusted(s, docs, text_col)
    if patterns is None:
        return s.withColumn("__all", F.col("__spans"))
    more = discovered(s, patterns, id_col)
    s = s.join(more, F.col(f"`{id_col}`").eqNullSafe(F.col("more_id")) & (F.col("__mark") == F.col("more_mark")), "left")
    return s.withColumn("__all", F.when(F.col("__more").isNull(), F.col("__spans")).otherwise(F.array_sort(F.concat("__spans", "__more"))))


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, base spans and all spans of every row; other columns of ``docs`` take no part, whatever their names.

    A null or empty text has no spans; a text of any length is searched whole. Rows of one id and one text get the same
    spans, and repeated identifiers count once as instances. Without seeds or trusted patterns, the base spans are all there
    are. An empty table gives no rows.
    """
    out = _all_spans(docs, text_col, id_col, F.col(f"`{id_col}`"))
    return out.select(F.col(f"`{id_col}`").alias("id"), F.col("__spans").alias("spans"), F.col("__all").alias("all_spans"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns, with every span of the text replaced by its kind in angle brackets; spans that overlap become one.

    A column n_chars is brought up to date. Null texts stay null, and empty ones empty; texts of any length are redacted whole,
    and an empty table stays empty. Further columns are kept as they are (names that begin with two underscores are this operator's).
    """
    d = _all_spans(docs, text_col, id_col, *[F.col(f"`{c}`") for c in docs.columns])
    text, name = F.col(f"`{text_col}`"), F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, CONTEXT)])

    def step(pos, x):
        inside = x["start"] < pos
        part = F.when(inside, "").otherwise(F.concat(F.substring(text, pos + 1, x["start"] - pos), F.get(name, x["kind"])))
        return F.struct(F.greatest(pos, x["end"]).alias("state"), part.alias("one"))

    end = F.array_max(F.transform("__all", lambda x: x["end"]))
    done = F.concat(F.concat_ws("", _fold(F.col("__all"), F.lit(0), "string", step)), F.substring(text, end + 1, F.length(text)))
    d = d.withColumn("__text", F.when(F.size("__all") > 0, done).otherwise(text))
    new = F.col("__text")
    return d.select(*[new.alias(c) if c == text_col else F.length(new).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans, all spans of every document, and how many of them the contexts added and there are in all."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k, c="spans": F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"),
        count(len(KINDS), "all_spans").alias("n_context"), F.size("all_spans").cast("long").alias("n_spans"),
    )


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced; see ``redact`` for odd rows."""
    return redact(docs)


QUERIES = {"op1_personal_data": op1_personal_data}
ORACLES: dict[str, str] = {}
