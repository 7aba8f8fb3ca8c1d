"""Driver tables as inputs of the library, in Spark and as SQL text for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators import lexical
from ..operators.filters import SECTION3_CLAUSES
from ..sources.store import exists

SOURCE_TYPES = ["statute", "guideline", "patent", "comparative_ip", "regulation", "case_law", "prior_art"]
LABELS = ["3", *SECTION3_CLAUSES, "BDA 3(a)", "4", "3(g)"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk, with kinds and scopes derived from its id and language."""
    d = table(spark, sf_dir, "documents")
    en = F.col("lang") == "en"
    kinds, labels = F.array(*map(F.lit, SOURCE_TYPES)), F.array(*map(F.lit, LABELS))
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.concat(F.lit("Document "), "doc_id").alias("title"),
        "text",
        F.element_at(labels, (F.col("doc_id") % len(LABELS) + 1).cast("int")).alias("section"),
        F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")).alias("source_type"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("effective_date"),
        F.when(F.col("doc_id") % 13 != 0, F.when(en, " India ").otherwise(F.col("lang"))).alias("jurisdiction"),
        F.when(F.col("doc_id") % 11 != 0, F.when(en, "domestic").otherwise("international")).alias("legal_scope"),
        F.lit(False).alias("is_fixture"),
        "doc_id",
    )


CHUNKS_SQL = f"""(SELECT 'd' || doc_id AS id, 'Document ' || doc_id AS title, text,
  {sql_list(LABELS)}[doc_id % {len(LABELS)} + 1] AS section, {sql_list(SOURCE_TYPES)}[doc_id % 7 + 1] AS source_type,
  CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN lang = 'en' THEN ' India ' ELSE lang END END AS jurisdiction,
  CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN lang = 'en' THEN 'domestic' ELSE 'international' END END AS legal_scope, doc_id
 FROM documents)"""


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(strip_accents(lower(coalesce({text}, ''))), '[a-z0-9]+(?:\\([a-z]\\))?'), lambda t: NOT list_contains({sql_list(STOPWORDS)}, t))"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's whole text as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERIES_SQL = "(SELECT item_id AS query_id, text AS query FROM benchmark)"

_INDEXES: dict[tuple[str, str], lexical.Index] = {}


def indexed_chunks(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The BM25 index of all chunks: written once for each application and folder of tables, then read."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES or not exists(spark, _INDEXES[key].path):
        _INDEXES[key] = lexical.index(chunks(spark, sf_dir), F.col("text"))
    return _INDEXES[key]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")
