"""From raw documents to token ids: language ID, near-dedup, personal data, mixing, pieces.

Each stage gets all rows that its predecessor kept. All but the last return the columns of
documents; the last adds ids, n_tokens and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import langid, minhash, mixing, pieces, pii
from docloom.llm.common import cut, table

#: Stages in their order: name and function of (spark, docs, sf_dir).
STAGES = [
    ("language_id", lambda spark, docs, sf_dir: langid.stage(spark, docs)),
    ("near_dedup", lambda spark, docs, sf_dir: minhash.stage(spark, docs)),
    ("personal_data", lambda spark, docs, sf_dir: pii.stage(spark, docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.stage(spark, docs)),
    ("pieces", lambda spark, docs, sf_dir: pieces.stage(spark, docs)),
]

#: Trained models decide here, which SQL cannot express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
