"""The corpus pipeline: each stage works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the docs of the next.  All but the last return the columns of documents.

Edge cases: rows with a null or wordless text have no language and go with the first stage.  Null ids, sources and labels
stay; of rows that repeat one stays (near copies).  Very long texts are read, sanitised and packed whole; windows of the
last stage are cut from them.  Ties between near copies go to the smallest doc_id.  Extra columns travel to
the last stage but one, and may have any names.  An empty table gives an empty result.  The tables written between stages
lie in the shared folder and are deleted when the session's process ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontam, langid, packing, sanitise, simhash
from siltstone.llm.common import Written, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are sanitised; n_chars follows."""
    done = sanitise.sanitise_text(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into training windows of token ids."""
    return packing.token_windows(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("private", private), ("pack", pack)]

ORACLE_SQL = None  # a kernel classifier, fingerprints, string tiling and bin packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Written(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.put(docs, f"{k}-{name}")
    return docs
