"""The corpus pipeline: toxicity, line dedup, near-dedup by Jaccard similarity, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last keep the
columns of ``documents``.

- toxicity drops the documents that the scorer rejects (score 0.7 or more);
- line_dedup takes cross-site boilerplate lines, of any length, out of the texts;
- near_dedup keeps of each component of near copies (SimHash candidates, Jaccard 0.8 of five-word shingles) the row of least id;
- decontaminate cuts the spans of benchmark windows out of the texts;
- encode returns the token counts and digests of what is left.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import bpe, decontam, line_dedup, near_copies, toxicity
from tracequarry.llm.common import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that score 0.7 or more, all columns kept; null and empty texts stay, and without labelled rows nothing goes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, drop_from=toxicity.THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, all columns kept, without cross-site boilerplate lines; nulls, blank and long lines as in ``drop_boilerplate``."""
    return line_dedup.drop_boilerplate(docs, counts=None)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, whatever the ids: of least id (null last), then of least text hash.

    A row goes only where another row of its own component stays, so rows of one
    id and different texts are told apart; of rows of one id and text the one
    whose columns hash lowest stays. Null and blank texts are copies of each
    other. Extra columns are passed through, whatever their names.
    """
    roots = near_copies.similar_texts(docs)
    # The input's columns travel inside one, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), near_copies.text_hash().alias("h"))
    light = rows.select("id", F.col("h").alias("th"))
    rooted = light.join(roots, light.th == roots.h, "left").select(F.coalesce("root", "th").alias("root"), F.struct(F.col("id").isNull().alias("no"), "id", "th").alias("key"))
    stay = rooted.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.th").alias("th"), F.col("key.id").alias("stays"))
    kept = rows.join(stay, (rows.h == stay.th) & rows.id.eqNullSafe(stay.stays))
    one = kept.groupBy("h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, all columns kept, with benchmark passages cut out of the texts; a null text stays null, an empty benchmark cuts nothing."""
    return decontam.cut_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row; extra columns are left out, a null text is empty."""
    import public_tokenizers

    return bpe.encode_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")), with_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: Learnt scores, fingerprint components and token merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written under the shared checkpoint folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "pipeline")
    place = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
