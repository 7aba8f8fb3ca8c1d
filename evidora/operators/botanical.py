"""Ingredient terms and plant names: joins that never choose between candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .kg import TRUSTED

THRESHOLD, DEFAULT_CONFIDENCE = 0.7, 0.85

# The code point ranges of the scripts, in the order of ties.
SCRIPTS = {"Deva": "\\u0900-\\u097F", "Beng": "\\u0980-\\u09FF", "Guru": "\\u0A00-\\u0A7F", "Gujr": "\\u0A80-\\u0AFF", "Orya": "\\u0B00-\\u0B7F", "Taml": "\\u0B80-\\u0BFF", "Telu": "\\u0C00-\\u0C7F", "Knda": "\\u0C80-\\u0CFF", "Mlym": "\\u0D00-\\u0D7F", "Arab": "\\u0600-\\u06FF"}


def ingredient_terms(ingredients: Column, botanical_input: Column, product: Column) -> Column:
    """Trimmed, not blank, unique in order; without any the botanical input, else the product."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(ingredients, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    other = F.coalesce(F.nullif(F.trim(botanical_input), F.lit("")), F.nullif(F.trim(product), F.lit("")))
    return F.when(F.size(clean) > 0, clean).otherwise(F.array_compact(F.array(other)))


def lookup(terms: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, botanical_name, synonyms, phytochemicals, confidence): one row a candidate.

    A name node with trusted MAY_REFER_TO edges decides alone; else trusted herbs
    with that name or alias.
    """
    asked = terms.select(normalize(F.col("term")).alias("term")).where("term != ''").distinct()
    known = nodes.select("key", "label", "origin", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda x: normalize(x)))).alias("term"))
    met = asked.join(known, "term")
    trusted = edges.where(F.col("origin").isin(TRUSTED))
    may = trusted.where("type = 'MAY_REFER_TO'").select(F.col("source").alias("key"), "target")
    referred = met.where("label = 'Name'").join(may, "key").select("term", F.col("target").alias("key")).distinct()
    herbs = met.where((F.col("label") == "Herb") & F.col("origin").isin(TRUSTED)).select("term", "key").join(referred, "term", "left_anti")
    parts = trusted.where("type = 'CONTAINS'").join(nodes.select(F.col("key").alias("target"), F.col("name").alias("part")), "target").groupBy(F.col("source").alias("key")).agg(F.sort_array(F.collect_list("part")).alias("phytochemicals"))
    found = referred.unionByName(herbs).join(nodes.select("key", "name", "aliases", "props"), "key").join(parts, "key", "left")
    return found.select(
        "term",
        F.col("name").alias("botanical_name"),
        F.array_distinct(F.concat(F.array("name"), "aliases")).alias("synonyms"),
        F.coalesce("phytochemicals", F.array().cast("array<string>")).alias("phytochemicals"),
        F.coalesce(F.try_element_at("props", F.lit("confidence")).try_cast("double"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
    )


def with_fallback(terms: DataFrame, candidates: DataFrame, second: DataFrame) -> DataFrame:
    """Candidates, and those of a second table for terms that have none."""
    asked = terms.select(normalize(F.col("term")).alias("term")).distinct()
    return candidates.unionByName(second.join(asked, "term", "left_semi").join(candidates, "term", "left_anti"))


def resolve(terms: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(term, status, botanical_name, confidence, n_candidates) of each distinct term; more than one candidate is AMBIGUOUS."""
    asked = terms.select("term").distinct().withColumn("_t", normalize(F.coalesce("term", F.lit(""))))
    found = candidates.groupBy(F.col("term").alias("_t")).agg(F.count("*").alias("n"), F.max("confidence").alias("top"), F.first("botanical_name").alias("only"))
    rows = asked.join(found, "_t", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n > 1, "AMBIGUOUS").when((n == 1) & (F.col("top") >= threshold), "RESOLVED").otherwise("UNRESOLVED")
    return rows.select("term", status.alias("status"), F.when(n == 1, F.col("only")).alias("botanical_name"), F.coalesce("top", F.lit(0.0)).alias("confidence"), n.alias("n_candidates"))


def case_botanicals(case_terms: DataFrame, resolved: DataFrame) -> DataFrame:
    """(case_id, primary_term, primary_status, ambiguous, reasons) of (case_id, pos, term)."""
    rows = case_terms.join(resolved, "term")
    out = rows.groupBy("case_id").agg(F.min_by("term", "pos").alias("primary_term"), F.min_by("status", "pos").alias("primary_status"), F.bool_or(F.col("status") == "AMBIGUOUS").alias("ambiguous"))
    return out.withColumn("reasons", F.when(F.col("ambiguous"), F.array(F.lit("ambiguous_botanical"))).otherwise(F.array().cast("array<string>")))


def identity_status(status: Column, botanical_name: Column, confidence: Column, threshold: float = THRESHOLD) -> Column:
    named = (status == "RESOLVED") & botanical_name.isNotNull()
    return F.when(status == "AMBIGUOUS", "ambiguous").when(named & (confidence >= threshold), "confirmed").when(named, "probable").otherwise("insufficient_evidence")


def canonical_terms(ingredients: DataFrame) -> DataFrame:
    """(formulation_id, terms) of (formulation_id, pos, user_term, botanical_name, synonyms, identity_status)."""
    more = F.slice(F.filter(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: s != F.col("botanical_name")), 1, 2)
    known = F.col("identity_status").isin("confirmed", "probable")
    terms = F.when(known, F.concat(F.array("botanical_name"), more)).when(F.col("identity_status") == "ambiguous", F.array().cast("array<string>")).otherwise(F.array("user_term"))
    rows = ingredients.select("formulation_id", "pos", terms.alias("t"))
    return rows.groupBy("formulation_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]))).alias("terms"))


def detect_script(text: Column) -> Column:
    """The script with most letters; ties to the one seen first; Latn without any."""
    counts = [F.struct((-F.length(F.regexp_replace(text, f"[^{r}]", ""))).alias("neg"), F.regexp_instr(text, F.lit(f"[{r}]")).alias("at"), F.lit(s).alias("script")) for s, r in SCRIPTS.items()]
    best = F.array_min(F.array(*counts))
    return F.when(best["neg"] < 0, best["script"]).otherwise("Latn")
