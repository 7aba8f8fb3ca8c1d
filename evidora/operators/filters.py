"""Row filters as Column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The section labels that stand for the supported clauses.
SECTION3_CLAUSES = [f"3({c})" for c in "abcdefhijklmnop"]
SCOPES = ["domestic", "international"]


def _scope(c: Column) -> Column:
    """Lower-cased scope, domestic if null; other values are an error."""
    value = F.lower(F.coalesce(c, F.lit("domestic")))
    return F.when(value.isin(SCOPES), value).otherwise(F.raise_error(F.concat(F.lit("unknown legal scope: "), value)))


def scope_filter(row_scope: Column, row_jurisdiction: Column, scope: Column, jurisdiction: Column) -> Column:
    """International: only international rows.  Domestic: domestic rows of the jurisdiction or of none."""
    wanted, own = _scope(scope), _scope(row_scope)
    j = F.lower(F.trim(F.coalesce(row_jurisdiction, F.lit(""))))
    here = F.coalesce(jurisdiction, F.lit("")) == ""
    return F.when(wanted == "international", own == "international").otherwise((own == "domestic") & (here | (j == "") | (j == F.lower(F.trim(jurisdiction)))))


def source_types(types: list[str] | None) -> list[str] | None:
    return sorted({t.strip().lower() for t in types or () if t and t.strip()}) or None


def source_type_filter(row_type: Column, types: list[str] | None) -> Column:
    wanted = source_types(types)
    return F.lit(True) if wanted is None else F.lower(row_type).isin(wanted)


def dense_prefilter(row_scope: Column, row_jurisdiction: Column, row_type: Column, scope: str | None, jurisdiction: str | None, types: list[str] | None) -> Column:
    """The filter before vector search: the row's scope must be present."""
    wanted = (scope or "domestic").lower()
    keep = F.coalesce(row_scope == wanted, F.lit(False))
    if wanted == "domestic" and jurisdiction and jurisdiction.strip():
        keep &= row_jurisdiction.isNull() | (row_jurisdiction == jurisdiction.strip().lower())
    if (held := source_types(types)) is not None:
        keep &= F.coalesce(row_type.isin(held), F.lit(False))
    return keep


def section_label_filter(row_type: Column, section: Column) -> Column:
    return (row_type == "statute") & F.lower(F.trim(F.coalesce(section, F.lit("")))).isin(["3", *SECTION3_CLAUSES])


def domain_allowlist(hits: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Hits whose host is an allowed domain or below one; the list is joined by every suffix of the host."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = domains.select(F.lower("domain").alias("_domain")).distinct()
    keyed = hits.withColumn("_domain", F.explode(F.array_distinct(suffixes)))
    return keyed.join(wanted, "_domain", "left_semi").select(*hits.columns)
