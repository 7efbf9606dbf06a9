"""What both jobs share: settings, logging, and the session of a command line."""

from __future__ import annotations

import json
import logging
import sys
from argparse import ArgumentParser
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Column formats that both jobs read, with Spark's readers of the same names.
FORMATS = ("parquet", "orc", "json")


def settings(defaults: dict, given: dict | None) -> dict:
    """Defaults with what is given; unknown names and values of other types are errors."""
    given = given or {}
    for k, v in given.items():
        if k not in defaults:
            raise ValueError(f"unknown setting: {k}")
        if type(v) is not type(defaults[k]) or isinstance(v, int) and v < 1:
            raise ValueError(f"setting {k}: bad value {v!r}")
    out = {**defaults, **given}
    if out.get("format") not in (None, *FORMATS):
        raise ValueError(f"setting format: {out['format']!r} is none of {', '.join(FORMATS)}")
    return out


@contextmanager
def held(spark: SparkSession, **conf: str):
    """Settings of the session for as long as the block runs; what was there comes back."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def command(name: str, about: str, paths: list[str], run: Callable[..., DataFrame], argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a job with path arguments and a JSON file of settings; without a session one is made and stopped. Returns the exit code."""
    p = ArgumentParser(prog=name, description=about)
    for x in paths:
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--config", help="JSON file of settings; by default the one beside the job")
    a = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    log = logger(name)
    try:
        given = json.loads(Path(a.pop("config") or Path(__file__).with_name(f"{name}.json")).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        log.error("settings: %s", e)
        return 2
    own = spark is None
    session = spark or SparkSession.builder.appName(name).getOrCreate()
    try:
        run(session, **a, given=given)
        return 0
    except ValueError as e:
        log.error("%s", e)
        return 2
    finally:
        if own:
            session.stop()
