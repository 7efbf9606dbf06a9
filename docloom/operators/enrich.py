"""Enrichment results by content: cache look-ups, model calls on misses only, and their statistics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docloom.checkpoints import cut
from docloom.shipping import ship

KEYS = ["kb_id", "artifact_type", "prompt_hash", "model_id"]
TASKS = ("skill", "rules", "style", "do_dont")
#: Parts of messages of failures that pass: worth another attempt.
PASSING = ("429", "rate limit", "500", "502", "503", "504", "timeout")


#: Instructions of each kind of task; the content follows them.
PROMPTS = {
    "summary": "Summarise this documentation page in two or three plain sentences.",
    "description": "Say in one line what this documentation page is for.",
    "skill": "Write a short skill guide for assistants from these page summaries: when to use the library and how to begin.",
    "rules": "List the coding rules that these page summaries state or clearly imply.",
    "style": "List the naming, layout and style conventions that these page summaries show.",
    "do_dont": "List what to do and what to avoid, in two lists, from these page summaries.",
    "llms_txt": "Write an index of these pages: a title, a one-line summary, and links by section.",
    "llms_full_txt": "Join these pages to one document with a table of contents.",
}


def prompt(task: Column, kb: Column, content: Column) -> Column:
    """The text sent to a model: instructions, the knowledge base's name and the content; null for an unknown task."""
    known = F.lit(None).cast("string")
    for k, text in PROMPTS.items():
        known = F.when(task == k, text).otherwise(known)
    return F.concat(known, F.lit("\n\nDocumentation: "), kb, F.lit("\n\n"), content)


def prompt_hash(content: Column, task: Column) -> Column:
    """SHA-256 of content and task; content is a page's body without front matter, so a new fetch time changes nothing."""
    return F.sha2(F.concat(content, task), 256)


def lookup(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Tasks with ``result`` and ``hit``: one left equi join on the four keys; the cache has each key once."""
    c = cache.select(*KEYS, F.col("result_json").alias("result"), F.lit(True).alias("there"))
    return tasks.join(c, KEYS, "left").withColumn("hit", F.coalesce("there", F.lit(False))).drop("there")


def stats(done: DataFrame) -> DataFrame:
    """One row: hits, misses and sums of tokens_in and tokens_out."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return done.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), n("tokens_in"), n("tokens_out"))


def task_total(pages: int) -> int:
    """Calls of a run without cache: a summary and a description for each page, and four for the whole."""
    return 2 * pages + len(TASKS)


def with_retries(call: Callable[[str], str], attempts: int = 3, base_s: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """The call, repeated after failures that pass, with doubled waits."""

    def run(prompt: str) -> str:
        for k in range(attempts):
            try:
                return call(prompt)
            except Exception as e:
                if k + 1 == attempts or not any(x in str(e).lower() for x in PASSING):
                    raise
                sleep(base_s * 2**k)
        raise AssertionError

    return run


def offline_model(prompt: str) -> str:
    """A stand-in that needs no network: the first line with text."""
    return next((x.strip("# ").strip() for x in prompt.splitlines() if x.strip("# ").strip()), "")


#: Model calls that one partition has under way at most.
CONCURRENT = 4


def complete(tasks: DataFrame, cache: DataFrame, call: Callable[[str], str] = offline_model, concurrent: int = CONCURRENT) -> DataFrame:
    """Tasks (the keys and content) with result, hit, tokens_in and tokens_out; misses call the model, failures give null.

    Each distinct key is asked for once, however many tasks have it (of their contents the least counts), and the answers are written before they
    are used: no later step, and no loss of an executor after a task has ended, asks again. A partition has a few calls under way at a time.
    """
    ship(tasks.sparkSession)
    known = lookup(tasks, cache)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = with_retries(call)

        def one(x: str | None) -> str | None:
            try:
                return None if x is None else ask(x)
            except Exception:
                return None

        with ThreadPoolExecutor(max_workers=concurrent) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(len(KEYS)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(KEYS))), pa.array(got, pa.string())], names=[*KEYS, "answer"])

    misses = known.filter(~F.col("hit")).groupBy(*KEYS).agg(F.min("content").alias("content"))
    answers = cut(misses.mapInArrow(run, ", ".join(f"{k} string" for k in KEYS) + ", answer string"), "answers")
    same = [F.col(f"k.{k}").eqNullSafe(F.col(f"a.{k}")) for k in KEYS]
    done = known.alias("k").join(answers.alias("a"), same, "left").select(*[F.col(f"k.{c}") for c in known.columns if c != "result"], F.when(F.col("k.hit"), F.col("k.result")).otherwise(F.col("a.answer")).alias("result"))
    words = lambda c: F.when(F.col("hit") | F.col("result").isNull(), 0).otherwise(F.size(F.split(F.trim(c), r"\s+"))).cast("long")
    return done.select(*known.columns).withColumn("tokens_in", words(F.col("content"))).withColumn("tokens_out", words(F.col("result")))
