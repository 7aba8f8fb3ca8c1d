"""Documents to chunks with deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify, strip
from .statutes import is_omitted, split_clauses, split_sections

GUIDELINE_CHARS = 1500
HEADING_CHARS = 120
PARAGRAPH_TYPES = ["guideline", "comparative_ip", "regulation", "case_law", "prior_art"]
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

CHUNK = ["id", "title", "text", "section", "source_type", "source_url", "effective_date", "jurisdiction", "legal_scope", "is_fixture"]


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def _is_heading(p: Column) -> Column:
    return ~p.contains("\n") & (F.length(p) <= HEADING_CHARS) & ~p.rlike(r"[.;:,]\s*$")


def guideline_groups(text: Column, max_chars: int = GUIDELINE_CHARS) -> Column:
    """array<struct<heading, text>>: paragraphs packed greedily under the heading before them."""
    group = "struct<heading:string,paras:array<string>>"
    start = F.struct(
        F.array().cast(f"array<{group}>").alias("groups"),
        F.lit(None).cast("string").alias("heading"),
        F.array().cast("array<string>").alias("current"),
        F.lit(0).alias("size"),
    )

    def flushed(acc: Column) -> Column:
        whole = F.struct(acc["heading"].alias("heading"), acc["current"].alias("paras"))
        return F.when(F.size(acc["current"]) > 0, F.concat(acc["groups"], F.array(whole))).otherwise(acc["groups"])

    def step(acc: Column, p: Column) -> Column:
        none = F.array().cast("array<string>")
        heading = F.struct(flushed(acc).alias("groups"), p.alias("heading"), none.alias("current"), F.lit(0).alias("size"))
        full = (F.size(acc["current"]) > 0) & (acc["size"] + F.length(p) > max_chars)
        packed = F.struct(
            F.when(full, flushed(acc)).otherwise(acc["groups"]).alias("groups"),
            acc["heading"].alias("heading"),
            F.when(full, F.array(p)).otherwise(F.concat(acc["current"], F.array(p))).alias("current"),
            F.when(full, F.length(p)).otherwise(acc["size"] + F.length(p)).alias("size"),
        )
        return F.when(_is_heading(p), heading).otherwise(packed)

    return F.aggregate(paragraphs(text), start, step, flushed)


def chunk_guidelines(docs: DataFrame, max_chars: int = GUIDELINE_CHARS) -> DataFrame:
    """One row a group of paragraphs; input has the columns of ``doc_meta`` and text."""
    groups = docs.select("*", F.posexplode(guideline_groups(F.col("text"), max_chars)).alias("_pos", "_group"))
    head = F.col("_group.heading")
    return groups.select(
        F.concat("doc_id", F.lit("_p"), F.lpad(F.col("_pos").cast("string"), F.greatest(F.lit(3), F.length(F.col("_pos").cast("string"))), F.lit("0"))).alias("id"),
        F.when(head.isNotNull(), F.concat("title", F.lit(" — "), head)).otherwise(F.col("title")).alias("title"),
        F.array_join("_group.paras", "\n\n").alias("text"),
        head.alias("section"),
        *[c for c in CHUNK[4:]],
    )


def chunk_patents(records: DataFrame) -> DataFrame:
    """The abstract and, if not blank, the first claim; the record's own url, date and jurisdiction come first.

    Input: publication_number, title, abstract, first_claim, url,
    publication_date, record_jurisdiction and the columns of ``doc_meta``.
    """
    pub = slugify(F.col("publication_number"))

    def own(field: str, meta: str) -> Column:
        return F.coalesce(F.when(F.col(field) != "", F.col(field)), F.col(meta))

    parts = F.array(
        F.struct(F.concat(F.lit("patent_"), pub, F.lit("_abstract")).alias("id"), strip(F.col("abstract")).alias("text"), F.lit("abstract").alias("section")),
        F.struct(F.concat(F.lit("patent_"), pub, F.lit("_claim_1")).alias("id"), strip(F.coalesce("first_claim", F.lit(""))).alias("text"), F.lit("claim 1").alias("section")),
    )
    return records.select("*", F.explode(parts).alias("_part")).where("_part.section = 'abstract' OR _part.text != ''").select(
        "_part.id",
        F.concat("title", F.lit(" ("), "publication_number", F.lit(")")).alias("title"),
        "_part.text",
        "_part.section",
        "source_type",
        own("url", "source_url").alias("source_url"),
        own("publication_date", "effective_date").alias("effective_date"),
        own("record_jurisdiction", "jurisdiction").alias("jurisdiction"),
        "legal_scope",
        "is_fixture",
    )


def chunk_statutes(docs: DataFrame) -> DataFrame:
    """Sections and clauses of statutes, without omitted clauses; one shuffle by document."""
    pieces = split_clauses(split_sections(docs)).where(F.col("letter").isNull() | ~is_omitted(F.col("text")))
    fields = docs.select("doc_id", F.xxhash64("text").alias("_same"), F.col("title").alias("_title"), "section_label_prefix", *CHUNK[4:]).dropDuplicates(["doc_id", "_same"])
    label = F.concat("number", F.when(F.col("letter").isNotNull(), F.concat(F.lit("("), "letter", F.lit(")"))).otherwise(F.lit("")))
    shown = F.concat_ws(" ", F.when(F.col("section_label_prefix") != "", F.col("section_label_prefix")), label)
    return pieces.join(fields, ["doc_id", "_same"]).select(
        F.concat_ws("_", "doc_id", slugify(F.col("number")), "letter").alias("id"), F.concat("_title", F.lit(" — Section "), shown).alias("title"), "text", shown.alias("section"), *CHUNK[4:]
    )


def branch(source_type: Column) -> Column:
    """statute, guideline (all paragraph types) or patent; raises while it runs on any other type."""
    unknown = F.raise_error(F.concat(F.lit("unsupported source_type "), F.coalesce(source_type, F.lit("null")))).cast("string")
    return F.when(source_type.isin("statute", "patent"), source_type).when(source_type.isin(PARAGRAPH_TYPES), "guideline").otherwise(unknown)


def chunk_corpus(statutes: DataFrame, guidelines: DataFrame, patents: DataFrame) -> DataFrame:
    """All chunks, by id; an id that occurs twice is an error."""
    union = chunk_statutes(statutes).unionByName(chunk_guidelines(guidelines)).unionByName(chunk_patents(patents))
    return require_unique(union).orderBy("id")


def require_unique(chunks: DataFrame, key: str = "id") -> DataFrame:
    """Raises while it runs if a key occurs twice."""
    counted = chunks.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*chunks.columns)).alias("_row"))
    message = F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))
    return counted.where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).select("_row.*")


def index_text(title: Column, section: Column, text: Column) -> Column:
    label = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section "), section))
    return F.concat_ws("\n", title, label, text)


def point_id(id: Column, prefix: str = "chunk:") -> Column:
    """UUIDv5 in the URL namespace of the prefix and the id."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat(F.lit(prefix), id), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_keys(chunks: DataFrame, prefix: str = "chunk:") -> DataFrame:
    return chunks.select("id", index_text(F.col("title"), F.col("section"), F.col("text")).alias("index_text"), point_id(F.col("id"), prefix).alias("point_id"))
