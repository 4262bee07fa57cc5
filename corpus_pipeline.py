"""Cleaning a document table for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents; all but the last return
the columns of ``docs``.  SQL cannot express the stages (hash fingerprints,
alignment, compression, Viterbi), so ORACLE_SQL is None and tests/llm compares
run() with a brute-force version.

Every stage takes null and empty texts as texts without words, keeps repeated
rows apart from its own decision, returns an empty table for an empty one, and
carries further columns, whatever their names, unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepulse.llm import decontaminate, pieces, quality, secret_scan, simhash
from carepulse.llm.common import parked, table
from carepulse.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by ``[SECRET]``; n_chars follows the text."""
    out = secret_scan.redact_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the text, with its piece ids (``ids``), their number
    (``n_pieces``), and whether they decode to the text (``round_trip``).  Null
    and empty texts have no pieces.  A column of the documents that has one of
    these three names is returned as ``doc_`` and its name."""
    own = ("ids", "n_pieces", "round_trip")
    rows, back = parked(docs, ["text"])
    taken = set(docs.columns) | set(own)

    def shown(name: str) -> str:
        while name in own or name != first and name in taken:
            name = f"doc_{name}"
        return name
    final = {}
    for place, first in back.items():
        final[place] = shown(first)
        taken.add(final[place])
    coded = pieces.decode_pieces(pieces.encode_pieces(rows), out="decoded")
    return coded.withColumns({
        "n_pieces": F.size("ids").cast("bigint"),
        "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")),
    }).drop("text", "decoded").withColumnsRenamed(final)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``.  The tables between the stages
    are written below the shared checkpoint folder; each is removed when the
    next one is written, the last when the session's JVM ends."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    home = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(home)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}_{STAGES[k - 1][0]}"), True)
        docs = spark.read.parquet(path)
    return docs
