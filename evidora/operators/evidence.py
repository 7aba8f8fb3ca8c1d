"""Accounting for the evidence behind model verdicts: ids, gaps, risk, fees, outcomes.

All tables are keyed by case_id, so a chain of these steps shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .filters import SECTION3_CLAUSES

# Weights of the clauses, notes and reasons.
RISK_WEIGHTS = {"3(d)": 0.35, "3(e)": 0.30, "3(p)": 0.35}
CLEARED_NOTE = "[trigger cleared: no valid retrieved source_id for this clause — evidence gap, human review required]"
REMOVED_NOTICE = "[Unsupported claims were removed pending human review.]"
HUMAN_REVIEW_REASONS = ["ambiguous_botanical", "insufficient_international_evidence", "section3_evidence_gap"]
MIN_SUPPORT = 0.6


def ordered_unique(arrays: Column) -> Column:
    return F.array_distinct(F.filter(arrays, lambda x: x.isNotNull() & (x != "")))


def clause_ref(ref: Column) -> Column:
    """ "Section 3(K)" and "3 (k)" become "3(k)"; anything else is trimmed."""
    letter = F.regexp_extract(ref, r"(?i)^\s*(?:section\s+)?3\s*\(\s*([a-z])\s*\)\s*$", 1)
    return F.when(letter != "", F.concat(F.lit("3("), F.lower(letter), F.lit(")"))).otherwise(strip(ref))


def drop_unsupported_clauses(provisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provisions with a supported clause, and per case the unsupported ones, once each in order."""
    rows = provisions.withColumn("clause", clause_ref(F.coalesce("clause", F.lit(""))))
    ok = F.col("clause").isin(SECTION3_CLAUSES)
    dropped = rows.where(~ok).groupBy("case_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clause"))), lambda x: x["clause"])).alias("unsupported"))
    return rows.where(ok), dropped


def valid_ids(findings: DataFrame, sources: DataFrame, keys: list[str], ids: str = "evidence_source_ids") -> DataFrame:
    """``ids`` without those that are not sources of the case; order and repeats stay."""
    held = sources.select("case_id", F.col("id").alias("_id")).distinct()
    rows = findings.select(*keys, "case_id", F.posexplode(ids).alias("_pos", "_id")) if "case_id" not in keys else findings.select(*keys, F.posexplode(ids).alias("_pos", "_id"))
    kept = rows.join(held, ["case_id", "_id"], "left_semi").groupBy(*dict.fromkeys([*keys, "case_id"])).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda x: x["_id"]).alias("_kept"))
    return findings.join(kept, list(dict.fromkeys([*keys, "case_id"])), "left").withColumn(ids, F.coalesce("_kept", F.array().cast(findings.schema[ids].dataType))).drop("_kept")


def sanitize_section3(provisions: DataFrame, sources: DataFrame) -> DataFrame:
    """Triggers without a valid source are cleared and become gaps.

    A source is valid for a provision if the case has it and its section names
    no clause or the same one.
    provisions: case_id, pos, clause, triggered, reason, evidence_source_ids;
    sources: case_id, id, section.
    """
    label = clause_ref(F.coalesce("section", F.lit("")))
    known = sources.select("case_id", F.col("id").alias("_id"), F.when(label.rlike(r"^3\([a-z]\)$"), label).alias("_label")).dropDuplicates(["case_id", "_id"])
    rows = provisions.select("case_id", "pos", "clause", F.posexplode("evidence_source_ids").alias("_at", "_id")).join(known, ["case_id", "_id"])
    kept = rows.where("_label IS NULL OR _label = clause").groupBy("case_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("_kept"))
    out = provisions.join(kept, ["case_id", "pos"], "left").withColumn("evidence_source_ids", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")
    gap = F.col("triggered") & (F.size("evidence_source_ids") == 0)
    return out.withColumn("evidence_gap", gap).withColumns({"reason": F.when(F.col("evidence_gap"), strip(F.concat(F.coalesce("reason", F.lit("")), F.lit(" " + CLEARED_NOTE)))).otherwise(F.col("reason")), "triggered": F.col("triggered") & ~F.col("evidence_gap")})


def section3_risk(provisions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(case_id, risk, triggered): clamped sum of the weights of the distinct triggered clauses."""
    held = weights or RISK_WEIGHTS
    table = F.create_map(*[x for k, v in held.items() for x in (F.lit(k), F.lit(v))])
    hit = provisions.where("triggered").groupBy("case_id", "clause").agg(F.min("pos").alias("pos"))
    scored = hit.groupBy("case_id").agg(F.sum(F.coalesce(F.try_element_at(table, F.col("clause")), F.lit(0.0))).alias("sum"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "clause"))), lambda x: x["clause"]).alias("triggered"))
    return provisions.select("case_id").distinct().join(scored, "case_id", "left").select("case_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.coalesce("sum", F.lit(0.0)), 9))).alias("risk"), F.coalesce("triggered", F.array().cast("array<string>")).alias("triggered"))


def provisions_by_clause(provisions: DataFrame) -> DataFrame:
    """The last provision of each clause of a case."""
    others = [c for c in provisions.columns if c not in ("case_id", "clause")]
    return provisions.groupBy("case_id", "clause").agg(F.max_by(F.struct(*others), "pos").alias("_p")).select("case_id", "clause", "_p.*")


def filter_citations(findings: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with valid ids only, and per case ``insufficient`` if no finding has any; probabilities in [0, 1]."""
    rows = valid_ids(findings, sources, keys)
    if "probability" in rows.columns:
        rows = rows.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability"))))
    cited = F.sum(F.size("evidence_source_ids")).over(Window.partitionBy("case_id"))
    return rows.withColumn("insufficient", cited == 0)


def evidence_gates(cases: DataFrame, sources: DataFrame, failed_queries: DataFrame) -> DataFrame:
    """(case_id, insufficient, human_review, reasons) of cases (case_id, legal_scope)."""
    had = sources.groupBy("case_id").agg(F.count("*").alias("n"), F.bool_or(F.col("legal_scope") == "international").alias("abroad"))
    rows = cases.join(had, "case_id", "left").join(failed_queries.select("case_id", "web_search_failed"), "case_id", "left")
    none, international = F.coalesce("n", F.lit(0)) == 0, F.col("legal_scope") == "international"
    foreign = international & (none | ~F.coalesce("abroad", F.lit(False)))
    reasons = F.array(F.when(foreign, "insufficient_international_evidence").when(none, "missing_evidence"), F.when(F.coalesce("web_search_failed", F.lit(False)), "web_search_failed"))
    return rows.select("case_id", (none | foreign).alias("insufficient"), foreign.alias("human_review"), F.array_compact(reasons).alias("reasons"))


def dimension_rating(findings: DataFrame, sources: DataFrame, ratings: DataFrame) -> DataFrame:
    """(case_id, dimension, rating, citations): INSUFFICIENT_EVIDENCE without citations; competitors without any are dropped.

    findings: case_id, dimension, kind, pos, evidence_source_ids; ratings: case_id, dimension, rating.
    """
    rows = valid_ids(findings, sources, ["case_id", "dimension", "kind", "pos"])
    cited = rows.where("kind != 'competitor' OR size(evidence_source_ids) > 0").groupBy("case_id", "dimension").agg(F.sum(F.size("evidence_source_ids")).alias("citations"), F.count("*").alias("findings"))
    out = ratings.join(cited, ["case_id", "dimension"], "left")
    n = F.coalesce("citations", F.lit(0))
    return out.select("case_id", "dimension", F.when(n == 0, "INSUFFICIENT_EVIDENCE").otherwise(F.col("rating")).alias("rating"), n.alias("citations"), F.coalesce("findings", F.lit(0)).alias("findings"))


def percentages_in_text(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(\d+(?:\.\d+)?)\s*(?:%|per\s*cent\b)"), 1), lambda x: x.cast("double"))


def rate_grounding(selections: DataFrame, sources: DataFrame) -> DataFrame:
    """Selections (case_id, percentage, source_id) with ``grounded``: the cited source of the case states the rate."""
    stated = sources.select("case_id", F.col("id").alias("source_id"), percentages_in_text(F.col("text")).alias("_p")).dropDuplicates(["case_id", "source_id"])
    found = F.exists(F.coalesce("_p", F.array().cast("array<double>")), lambda x: F.abs(x - F.col("percentage")) < 1e-9)
    return selections.join(stated, ["case_id", "source_id"], "left").withColumn("grounded", F.coalesce(found & F.col("percentage").isNotNull(), F.lit(False))).drop("_p")


def abs_fee(turnover: Column, percentage: Column) -> Column:
    """turnover * percentage / 100 in decimals, half up to 0.01; other ranges are an error."""
    bad = (turnover < 0) | (percentage < 0) | (percentage > 100)
    exact = turnover.cast("decimal(18,4)") * percentage.cast("decimal(9,6)") / F.lit(100).cast("decimal(3,0)")
    return F.when(bad, F.raise_error(F.lit("turnover or percentage out of range")).cast("double")).otherwise(F.round(exact, 2).cast("double"))


def abs_calculation(requests: DataFrame, selections: DataFrame) -> DataFrame:
    """(case_id, fee, percentage, source_id, reason) of requests (case_id, annual_turnover_inr, percentage_override)."""
    rows = requests.join(selections.select("case_id", "percentage", "source_id", "grounded"), "case_id", "left")
    own = F.col("percentage_override").isNotNull()
    rate = F.coalesce("percentage_override", F.when(F.col("grounded"), F.col("percentage")))
    has = F.col("annual_turnover_inr").isNotNull()
    reason = F.when(~has | own, F.lit(None)).when(F.col("percentage").isNull(), "missing_abs_rate_evidence").when(~F.col("grounded"), "rate_not_grounded_in_source")
    done = has & rate.isNotNull()
    return rows.select("case_id", F.when(done, abs_fee(F.col("annual_turnover_inr"), rate)).alias("fee"), F.when(done, rate).alias("percentage"), F.when(done & ~own, F.col("source_id")).alias("source_id"), reason.alias("reason"))


def abs_applicability(verdicts: DataFrame, sources: DataFrame, requests: DataFrame) -> DataFrame:
    """(case_id, status, insufficient, skip_fee): without valid citations UNCERTAIN; NOT_APPLICABLE without override skips the fee."""
    rows = valid_ids(verdicts, sources, ["case_id"]).join(requests.select("case_id", "percentage_override"), "case_id", "left")
    none = F.size("evidence_source_ids") == 0
    status = F.when(none, "UNCERTAIN").otherwise(F.col("status"))
    return rows.select("case_id", status.alias("status"), none.alias("insufficient"), ((status == "NOT_APPLICABLE") & F.col("percentage_override").isNull()).alias("skip_fee"))


def draft_sentences(draft: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(draft, F.lit("")), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def collect_claims(parts: DataFrame) -> DataFrame:
    """(case_id, pos, claim) of parts (case_id, part, pos, text): trimmed, not blank, first occurrence of each, in order."""
    rows = parts.withColumn("claim", strip(F.coalesce("text", F.lit("")))).where("claim != ''")
    first = rows.groupBy("case_id", "claim").agg(F.min(F.struct("part", "pos")).alias("_at"))
    return first.select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy("_at")).alias("pos"), "claim")


def verify_rollup(cases: DataFrame, verdicts: DataFrame, sources: DataFrame, review_reasons: list[str] | None = None) -> DataFrame:
    """(case_id, outcome, support_ratio, stripped, reasons).

    cases: case_id, reasons array, stripped array (claims the model gave back);
    verdicts: case_id, pos, claim, status.  A PASS becomes a review if one of
    ``review_reasons`` is present.
    """
    good = F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED")
    v = verdicts.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.array_sort(F.collect_list(F.struct("pos", "claim", "status"))).alias("_v"))
    s = sources.groupBy("case_id").agg(F.count("*").alias("n_sources"))
    rows = cases.join(v, "case_id", "left").join(s, "case_id", "left")
    none = F.array().cast("array<string>")
    claims = F.coalesce(F.transform("_v", lambda x: x["claim"]), none)
    bad = F.coalesce(F.transform(F.filter("_v", lambda x: x["status"] == "UNSUPPORTED"), lambda x: x["claim"]), none)
    no_sources, no_claims = F.coalesce("n_sources", F.lit(0)) == 0, F.coalesce("n", F.lit(0)) == 0
    ratio = F.coalesce("good", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))
    given = F.coalesce("stripped", none)
    stripped = F.when(no_sources, claims).when(no_claims, none).otherwise(F.when(F.size(given) > 0, given).otherwise(bad))
    rows = rows.withColumns({"_none": no_sources, "_empty": no_claims, "ratio": ratio, "stripped": stripped, "reasons": F.coalesce("reasons", none)})
    forced = F.arrays_overlap("reasons", F.array(*map(F.lit, HUMAN_REVIEW_REASONS)))
    outcome = (
        F.when(F.col("_none"), "HUMAN_REVIEW_REQUIRED")
        .when(F.col("_empty"), "PASS")
        .when(forced, "HUMAN_REVIEW_REQUIRED")
        .when((F.size("stripped") > 0) & (F.col("ratio") < MIN_SUPPORT), "FAIL")
        .when(F.size("stripped") > 0, "HUMAN_REVIEW_REQUIRED")
        .otherwise("PASS")
    )
    rows = rows.withColumn("outcome", outcome)
    extra = F.when(F.col("_none"), "missing_evidence").when(F.col("_empty") | forced, None).when(F.col("outcome") == "FAIL", "unsupported_claims").when(F.size("stripped") > 0, "partial_unsupported_claims")
    rows = rows.withColumn("reasons", ordered_unique(F.concat("reasons", F.array(extra))))
    if review_reasons:
        raised = (F.col("outcome") == "PASS") & F.arrays_overlap("reasons", F.array(*map(F.lit, review_reasons)))
        rows = rows.withColumn("outcome", F.when(raised, "HUMAN_REVIEW_REQUIRED").otherwise(F.col("outcome")))
    return rows.select("case_id", "outcome", F.col("ratio").alias("support_ratio"), "stripped", "reasons")


def strip_claims(draft: Column, stripped: Column) -> Column:
    """The draft without the stripped claims, with a notice if there were any."""
    cut = F.aggregate(stripped, draft, lambda acc, claim: F.replace(acc, claim, F.lit("")))
    clean = strip(F.regexp_replace(cut, "\n{3,}", "\n\n"))
    noticed = F.concat(F.when(clean != "", F.concat(clean, F.lit("\n\n"))).otherwise(F.lit("")), F.lit(REMOVED_NOTICE))
    return F.when(F.coalesce(draft, F.lit("")) == "", draft).when(F.size(stripped) > 0, noticed).otherwise(clean)


def case_report(ratings: DataFrame, findings: DataFrame, sources: DataFrame, dimensions: list[str]) -> DataFrame:
    """(case_id, summary, draft, evidence): one row a case, never a combined score."""
    wide = ratings.groupBy("case_id").pivot("dimension", dimensions).agg(F.first("rating"))
    summary = F.concat_ws("; ", *[F.concat(F.lit(f"{d}: "), F.coalesce(F.col(f"`{d}`"), F.lit("INSUFFICIENT_EVIDENCE"))) for d in dimensions])
    drafts = findings.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "pos", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("draft"))
    ids = sources.groupBy("case_id").agg(F.concat(F.lit("Evidence: "), F.array_join(F.sort_array(F.collect_set("id")), ", ")).alias("evidence"))
    out = wide.select("case_id", summary.alias("summary")).join(drafts, "case_id", "left").join(ids, "case_id", "left")
    return out.select("case_id", "summary", F.coalesce("draft", F.lit("")).alias("draft"), F.coalesce("evidence", F.lit("Insufficient evidence.")).alias("evidence"))
