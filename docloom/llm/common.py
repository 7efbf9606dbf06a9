"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docloom.checkpoints import cut, new_path  # noqa: F401  the operators take them from here
from docloom.shipping import ship

#: Rows of an Arrow batch at most: whole texts travel in these batches.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Rows that Spark's reader decodes at once, and bytes of a row group that a writer holds: both hold whole texts.
READ_ROWS, GROUP_BYTES = 1024, 32 << 20

WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> None:
    """Make the package known to the executors and bound what tasks hold of whole texts: Arrow batches, batches of the reader, and row groups."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b"), ("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS)), ("parquet.block.size", str(GROUP_BYTES))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def freed(run: Callable, after: Callable[[], None] | None = None) -> Callable:
    """A function of Arrow batches that calls ``after`` and gives its memory back when its task ends: Python workers live on, and the next task's executor memory is theirs too."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if after is not None:
                after()
            pa.default_memory_pool().release_unused()
            with suppress(Exception):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(-1)).cast("int")


#: Bits of a bitmap at most (32 MB): beyond it, more places are shared and fewer rows spared, nothing else.
MOST_BITS = 28
_CHUNK = 20  # bits of the places of one chunk


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """The bits of all places (one long column, under 2^bits), as bytes: every task sets those of its chunks, and chunks alone go to the driver."""
    name = places.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            for k in np.unique(at >> _CHUNK).tolist():
                mine = np.unique(at[at >> _CHUNK == k] & ((1 << _CHUNK) - 1))
                np.bitwise_or.at(held.setdefault(k, np.zeros(1 << _CHUNK - 3, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "data"])

    out = np.zeros(max(1 << bits, 1 << _CHUNK) >> 3, np.uint8)
    dealt = places.repartition(max(1, 1 << max(0, bits - _CHUNK)), F.shiftright(name, _CHUNK))
    for r in dealt.mapInArrow(freed(run), "chunk long, data binary").collect():
        out[r["chunk"] << _CHUNK - 3 : r["chunk"] + 1 << _CHUNK - 3] |= np.frombuffer(r["data"], np.uint8)
    return out


def bits_for(n: int) -> int:
    """Bits of a bitmap in which n places share few."""
    return min(MOST_BITS, max(16, (16 * max(1, n) - 1).bit_length()))


def append(df: DataFrame, text_col: str, fields: list[T.StructField], fn: Callable[[list], list[list]], after: Callable[[], None] | None = None) -> DataFrame:
    """All columns of ``df`` and new ones that ``fn`` computes from lists of texts, batch by batch.

    ``fn`` takes a list of texts (str or None) and returns a list of values, or an Arrow array, for each new field;
    ``after`` is called at each task's end. A column of ``df`` that has the name of a new field, in whatever case, is replaced.
    """
    tune(df.sparkSession)
    names = {f.name.lower() for f in fields} - {text_col.lower()}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = T.StructType([*[f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in fields}], *fields])
    at = [c.lower() for c in df.columns].index(text_col.lower())
    kept = [i for i, f in enumerate(df.schema.fields) if f.name in schema.fieldNames()[: len(schema) - len(fields)]]
    kinds = [ARROW[f.dataType.simpleString()] for f in fields]
    new = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *(v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(got, kinds))], names=[*(b.schema.names[i] for i in kept), *new])

    return df.mapInArrow(freed(run, after), schema)


ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()),
    "array<string>": pa.list_(pa.string()),
}
