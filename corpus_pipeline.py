"""Training-data pipeline over the table of documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of ``documents``:

1. toxicity: rows that the subword model predicts toxic go;
2. line dedup: lines of recurring templates go, other lines stay;
3. near-dedup: one document of each component stays;
4. mixing: sources reach their target weights; each pass over a source gives
   one row for each run of words that it takes from a document;
5. byte-level BPE: one row for each of those with its token count and digests.

Defined cases, in every stage: null and empty texts stay and have neither words nor
lines (near-dedup keeps one row of each id and text; mixing takes no words from them and gives
no row); null ids stay, and are kept before no other id of their component; null
sources are a source, the last one.  Columns beside those of ``documents`` go along, whatever
their names, up to mixing.  Long texts are read in blocks.  Empty tables give empty
tables.  Without labels of both kinds every row has the same score, the share of label 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidora.llm import bpe, mixing, setsketch, templates, toxicity
from evidora.llm.queries import ranks_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.drop(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, ranks_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages hold trained models and sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
