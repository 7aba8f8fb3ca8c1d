"""Queries over evidence and plant names, each with its SQL.

Orders are cases; their lines give sources, provisions, findings and verdicts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import botanical, evidence
from ..queries import query
from .adapters import sql_list, table

_SECTIONS = ["3", "3(d)", "3 (E)", "Section 3(p)", "4", "3(k)", " guideline "]
_CLAUSES = ["3(d)", "section 3 (E)", "3(P)", "3(g)", " 3(k)", "3(q)"]


def _lines(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    li = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order))
    return li.select(
        F.col("l_orderkey").alias("case_id"), "pos", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), F.col("l_suppkey").alias("n"),
        F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("l_partkey") % len(_SECTIONS) + 1).cast("int")).alias("section"),
        F.element_at(F.array(*map(F.lit, _CLAUSES)), (F.col("l_suppkey") % len(_CLAUSES) + 1).cast("int")).alias("clause"),
        (F.col("l_returnflag") != "N").alias("triggered"), F.lit("because").alias("reason"),
        F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string"))).alias("evidence_source_ids"),
        "l_linestatus", "l_returnflag", "l_discount", "l_partkey", "l_linenumber", "l_quantity",
    )


_LINES = f"""l AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS pos, 's' || l_suppkey AS id, l_suppkey AS n,
 {sql_list(_SECTIONS)}[l_partkey % {len(_SECTIONS)} + 1] AS section, {sql_list(_CLAUSES)}[l_suppkey % {len(_CLAUSES)} + 1] AS clause, l_returnflag <> 'N' AS triggered, ['s' || l_suppkey, 's' || l_suppkey % 7] AS ids,
 l_linestatus, l_returnflag, l_discount, l_partkey, l_linenumber, l_quantity FROM lineitem)"""


def _ref(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '(?i)^\\s*(?:section\\s+)?3\\s*\\(\\s*([a-z])\\s*\\)\\s*$') THEN '3(' || lower(regexp_extract({c}, '\\(\\s*([a-zA-Z])', 1)) || ')' ELSE trim({c}) END"


_SUPPORTED = "('" + "', '".join(evidence.SECTION3_CLAUSES) + "')"


@query("clause_ref", f"WITH {_LINES}, r AS (SELECT case_id, pos, {_ref('clause')} AS clause FROM l) SELECT case_id, 0 AS pos, array_to_string(list(clause ORDER BY f), '|') AS clause FROM (SELECT case_id, clause, min(pos) AS f FROM r WHERE clause NOT IN {_SUPPORTED} GROUP BY ALL) GROUP BY case_id UNION ALL SELECT case_id, pos, clause FROM r WHERE clause IN {_SUPPORTED}")
def clause_ref(spark, sf_dir):
    kept, dropped = evidence.drop_unsupported_clauses(_lines(spark, sf_dir))
    return kept.select("case_id", F.col("pos").cast("long").alias("pos"), "clause").unionByName(dropped.select("case_id", F.lit(0).cast("long").alias("pos"), F.array_join("unsupported", "|").alias("clause")))


# A source's section follows from its supplier, so that a supplier that occurs twice in a case is one source.
_SUPPLIER_SECTION = f"{sql_list(_SECTIONS)}[n % {len(_SECTIONS)} + 1]"
_PROV = f"""{_LINES}, src AS (SELECT DISTINCT case_id, id, {_ref(_SUPPLIER_SECTION)} AS ref FROM l), p AS (SELECT case_id, pos, {_ref('clause')} AS clause, triggered, ids FROM l WHERE {_ref('clause')} IN {_SUPPORTED}),
 e AS (SELECT p.case_id, p.pos, p.clause, k, ids[k] AS id FROM p, (SELECT unnest([1, 2]) AS k)), ok AS (SELECT e.case_id, pos, list(e.id ORDER BY k) AS kept FROM e JOIN src ON src.case_id = e.case_id AND src.id = e.id WHERE NOT regexp_matches(ref, '^3\\([a-z]\\)$') OR ref = clause GROUP BY ALL),
 prov AS (SELECT p.case_id, p.pos, clause, triggered AND kept IS NOT NULL AS triggered, triggered AND kept IS NULL AS evidence_gap, coalesce(kept, []) AS kept FROM p LEFT JOIN ok USING (case_id, pos))"""


def _by_supplier(rows):
    return rows.withColumn("section", F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("n") % len(_SECTIONS) + 1).cast("int"))).dropDuplicates(["case_id", "id"])


def _sanitized(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    kept, _ = evidence.drop_unsupported_clauses(rows)
    return evidence.sanitize_section3(kept.select("case_id", "pos", "clause", "triggered", "reason", "evidence_source_ids"), _by_supplier(rows).select("case_id", "id", "section"))


@query("sanitize_section3", f"WITH {_PROV} SELECT case_id, pos, clause, triggered, evidence_gap, array_to_string(kept, '|') AS ids, CASE WHEN evidence_gap THEN 'because {evidence.CLEARED_NOTE}' ELSE 'because' END AS reason FROM prov")
def sanitize_section3(spark, sf_dir):
    return _sanitized(spark, sf_dir).select("case_id", F.col("pos").cast("long").alias("pos"), "clause", "triggered", "evidence_gap", F.array_join("evidence_source_ids", "|").alias("ids"), "reason")


@query("section3_risk", f"WITH {_PROV}, t AS (SELECT case_id, clause, min(pos) AS f FROM prov WHERE triggered GROUP BY ALL), s AS (SELECT case_id, least(1, round(sum(CASE clause WHEN '3(d)' THEN 0.35 WHEN '3(e)' THEN 0.30 WHEN '3(p)' THEN 0.35 ELSE 0 END), 9)) AS risk, array_to_string(list(clause ORDER BY f), '|') AS triggered FROM t GROUP BY 1) SELECT c.case_id, CAST(coalesce(risk, 0) AS DOUBLE) AS risk, coalesce(triggered, '') AS triggered FROM (SELECT DISTINCT case_id FROM prov) c LEFT JOIN s USING (case_id)")
def section3_risk(spark, sf_dir):
    return evidence.section3_risk(_sanitized(spark, sf_dir)).withColumn("triggered", F.array_join("triggered", "|"))


@query("filter_citations", f"WITH {_LINES}, h AS (SELECT DISTINCT case_id, id FROM l), f AS (SELECT l.case_id, l.pos, k, ids[k] AS id FROM l, (SELECT unnest([1, 2]) AS k)), g AS (SELECT case_id, pos, list(id ORDER BY k) AS kept FROM f JOIN h USING (case_id, id) WHERE id <> 's1' GROUP BY ALL) SELECT l.case_id, l.pos, coalesce(array_to_string(kept, '|'), '') AS ids, sum(coalesce(len(kept), 0)) OVER (PARTITION BY l.case_id) = 0 AS insufficient, least(1, l_quantity / 40) AS probability FROM l LEFT JOIN g USING (case_id, pos)")
def filter_citations(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    findings = rows.select("case_id", "pos", "evidence_source_ids", (F.col("l_quantity") / 40).alias("probability"))
    out = evidence.filter_citations(findings, rows.where("id != 's1'").select("case_id", "id"), ["case_id", "pos"])
    return out.select("case_id", F.col("pos").cast("long").alias("pos"), F.array_join("evidence_source_ids", "|").alias("ids"), "insufficient", "probability")


@query("evidence_gates", "WITH s AS (SELECT l_orderkey AS case_id, count(*) AS n, bool_or(l_returnflag = 'R') AS abroad FROM lineitem WHERE l_quantity > 30 GROUP BY 1), c AS (SELECT o_orderkey AS case_id, o_orderstatus = 'F' AS intl, o_orderpriority LIKE '1%' AS failed FROM orders), r AS (SELECT case_id, n IS NULL AS none, intl AND (n IS NULL OR NOT abroad) AS far, failed FROM c LEFT JOIN s USING (case_id)) SELECT case_id, none OR far AS insufficient, far AS human_review, array_to_string(list_filter([CASE WHEN far THEN 'insufficient_international_evidence' WHEN none THEN 'missing_evidence' END, CASE WHEN failed THEN 'web_search_failed' END], lambda x: x IS NOT NULL), '|') AS reasons FROM r")
def evidence_gates(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "international").otherwise("domestic").alias("legal_scope"))
    sources = li.where("l_quantity > 30").select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_returnflag") == "R", "international").otherwise("domestic").alias("legal_scope"))
    failed = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").startswith("1").alias("web_search_failed"))
    return evidence.evidence_gates(cases, sources, failed).withColumn("reasons", F.array_join("reasons", "|"))


_DIM = "CASE l_linenumber % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'market' ELSE 'resource' END"
_RATED = f"""{_LINES}, d AS (SELECT *, {_DIM} AS dimension, CASE WHEN l_linenumber % 2 = 0 THEN 'competitor' ELSE 'finding' END AS kind FROM l), h AS (SELECT DISTINCT case_id, id FROM l WHERE l_discount > 0.03),
 v AS (SELECT d.case_id, d.pos, dimension, kind, count(h.id) AS c FROM d CROSS JOIN (SELECT unnest([1, 2]) AS k) LEFT JOIN h ON h.case_id = d.case_id AND h.id = d.ids[k] GROUP BY ALL),
 s AS (SELECT case_id, dimension, sum(c) AS citations, count(*) AS findings FROM v WHERE kind <> 'competitor' OR c > 0 GROUP BY ALL),
 rated AS (SELECT o_orderkey AS case_id, dim AS dimension, CASE WHEN coalesce(citations, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'GOOD' END AS rating, coalesce(citations, 0) AS citations, coalesce(findings, 0) AS findings FROM orders CROSS JOIN (SELECT unnest(['legal', 'market', 'resource']) AS dim) LEFT JOIN s ON s.case_id = o_orderkey AND s.dimension = dim)"""


def _findings(spark, sf_dir):
    m = F.col("l_linenumber") % 3
    dim = F.when(m == 0, "legal").when(m == 1, "market").otherwise("resource")
    rows = _lines(spark, sf_dir)
    return rows.select("case_id", dim.alias("dimension"), F.when(F.col("l_linenumber") % 2 == 0, "competitor").otherwise("finding").alias("kind"), "pos", "evidence_source_ids"), rows.where("l_discount > 0.03").select("case_id", "id")


def _ratings(spark, sf_dir):
    findings, sources = _findings(spark, sf_dir)
    given = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(F.lit("legal"), F.lit("market"), F.lit("resource"))).alias("dimension"), F.lit("GOOD").alias("rating"))
    return evidence.dimension_rating(findings, sources, given)


@query("dimension_rating", f"WITH {_RATED} SELECT case_id, dimension, rating, CAST(citations AS BIGINT) AS citations, findings FROM rated")
def dimension_rating(spark, sf_dir):
    return _ratings(spark, sf_dir).select("case_id", "dimension", "rating", F.col("citations").cast("long").alias("citations"), F.col("findings").cast("long").alias("findings"))


@query("case_report", f"WITH {_RATED}, w AS (SELECT case_id, string_agg(dimension || ': ' || rating, '; ' ORDER BY dimension) AS summary FROM rated GROUP BY 1), dr AS (SELECT case_id, string_agg('- ' || id, chr(10) ORDER BY dimension, pos) AS draft FROM d GROUP BY 1), ev AS (SELECT case_id, 'Evidence: ' || array_to_string(list(DISTINCT id ORDER BY id), ', ') AS evidence FROM h GROUP BY 1) SELECT w.case_id, summary, coalesce(draft, '') AS draft, coalesce(evidence, 'Insufficient evidence.') AS evidence FROM w LEFT JOIN dr USING (case_id) LEFT JOIN ev USING (case_id)")
def case_report(spark, sf_dir):
    findings, sources = _findings(spark, sf_dir)
    texts = findings.withColumn("text", F.element_at("evidence_source_ids", 1))
    return evidence.case_report(_ratings(spark, sf_dir), texts, sources, ["legal", "market", "resource"])


@query("percentages_in_text", f"WITH {_LINES} SELECT case_id, pos, array_to_string(list_transform(regexp_extract_all('The rate is 0.' || l_linenumber || ' per cent, or ' || n % 5 || '% of it; 0.5percent', '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:%|per\\s*cent\\b)', 1), lambda x: x::DOUBLE), '|') AS pcts FROM l")
def percentages_in_text(spark, sf_dir):
    text = F.concat(F.lit("The rate is 0."), "l_linenumber", F.lit(" per cent, or "), F.col("n") % 5, F.lit("% of it; 0.5percent"))
    return _lines(spark, sf_dir).select("case_id", F.col("pos").cast("long").alias("pos"), F.array_join(evidence.percentages_in_text(text).cast("array<string>"), "|").alias("pcts"))


def _selected(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    sources = rows.groupBy("case_id", "id").agg(F.concat(F.lit("rate 0."), F.min("l_linenumber").cast("string"), F.lit(" per cent")).alias("text"))
    first = rows.where("pos = 1").select("case_id", F.round(F.col("l_discount") * 10, 1).alias("percentage"), F.when(F.col("n") % 4 != 0, F.col("id")).otherwise(F.lit("s0")).alias("source_id"))
    return evidence.rate_grounding(first.where("case_id % 5 != 0"), sources)


_GROUND = f"{_LINES}, sr AS (SELECT case_id, id, min(l_linenumber) / 10.0::DOUBLE AS p FROM l GROUP BY ALL), sel AS (SELECT case_id, round(l_discount * 10, 1) AS percentage, CASE WHEN n % 4 <> 0 THEN id ELSE 's0' END AS source_id FROM l WHERE pos = 1 AND case_id % 5 <> 0), gr AS (SELECT sel.*, coalesce(abs(p - percentage) < 1e-9, false) AS grounded FROM sel LEFT JOIN sr ON sr.case_id = sel.case_id AND sr.id = source_id)"


@query("rate_grounding", f"WITH {_GROUND} SELECT case_id, percentage, source_id, grounded FROM gr")
def rate_grounding(spark, sf_dir):
    return _selected(spark, sf_dir).select("case_id", "percentage", "source_id", "grounded")


@query("abs_fee", "SELECT o_orderkey AS case_id, CAST((CAST(round(CAST(o_totalprice AS DECIMAL(18, 2)) * 100, 0) AS HUGEINT) * (o_custkey % 100 + 1) + 5000) // 10000 AS DOUBLE) / 100 AS fee FROM orders")
def abs_fee(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), evidence.abs_fee(F.round("o_totalprice", 2), (F.col("o_custkey") % 100 + 1) / 100).alias("fee"))


@query("abs_calculation", f"WITH {_GROUND}, q AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS t, CASE WHEN o_orderkey % 9 = 0 THEN 0.5::DOUBLE END AS o FROM orders), r AS (SELECT q.*, percentage, source_id, grounded, coalesce(o, CASE WHEN grounded THEN percentage END) AS rate FROM q LEFT JOIN gr USING (case_id)) SELECT case_id, CASE WHEN t IS NOT NULL THEN CAST((CAST(round(CAST(t AS DECIMAL(18, 2)) * 100, 0) AS HUGEINT) * CAST(round(rate * 10) AS BIGINT) + 500) // 1000 AS DOUBLE) / 100 END AS fee, CASE WHEN t IS NOT NULL THEN rate END AS percentage, CASE WHEN t IS NOT NULL AND rate IS NOT NULL AND o IS NULL THEN source_id END AS source_id, CASE WHEN t IS NULL OR o IS NOT NULL THEN NULL WHEN percentage IS NULL THEN 'missing_abs_rate_evidence' WHEN NOT grounded THEN 'rate_not_grounded_in_source' END AS reason FROM r")
def abs_calculation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    requests = o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice", 2)).alias("annual_turnover_inr"), F.when(F.col("o_orderkey") % 9 == 0, F.lit(0.5)).alias("percentage_override"))
    return evidence.abs_calculation(requests, _selected(spark, sf_dir))


@query("abs_applicability", f"WITH {_LINES}, h AS (SELECT DISTINCT case_id, id FROM l WHERE l_discount > 0.03), v AS (SELECT case_id, ids, CASE WHEN n % 2 = 0 THEN 'NOT_APPLICABLE' ELSE 'APPLICABLE' END AS status FROM l WHERE pos = 1), r AS (SELECT v.case_id, v.status, count(h.id) = 0 AS none FROM v CROSS JOIN (SELECT unnest([1, 2]) AS k) LEFT JOIN h ON h.case_id = v.case_id AND h.id = ids[k] GROUP BY ALL) SELECT case_id, CASE WHEN none THEN 'UNCERTAIN' ELSE status END AS status, none AS insufficient, NOT none AND status = 'NOT_APPLICABLE' AND case_id % 9 <> 0 AS skip_fee FROM r")
def abs_applicability(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    verdicts = rows.where("pos = 1").select("case_id", "evidence_source_ids", F.when(F.col("n") % 2 == 0, "NOT_APPLICABLE").otherwise("APPLICABLE").alias("status"))
    requests = rows.select("case_id", F.when(F.col("case_id") % 9 == 0, F.lit(0.5)).alias("percentage_override")).distinct()
    return evidence.abs_applicability(verdicts, rows.where("l_discount > 0.03").select("case_id", "id"), requests)


def _claim(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.select("case_id", F.col("l_linestatus").alias("part"), "pos", F.concat(F.lit(" claim "), (F.col("n") % 9).cast("string"), F.lit(". ")).alias("text"), "n", "l_returnflag")


_CLAIMS = f"{_LINES}, cl AS (SELECT case_id, 'claim ' || n % 9 || '.' AS claim, min(struct_pack(a := l_linestatus, b := pos)) AS f FROM l GROUP BY ALL), claims AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY f) AS pos, claim FROM cl)"


@query("collect_claims", f"WITH {_CLAIMS} SELECT * FROM claims")
def collect_claims(spark, sf_dir):
    return evidence.collect_claims(_claim(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


def _rolled(spark, sf_dir):
    claims = evidence.collect_claims(_claim(spark, sf_dir))
    k = (F.col("case_id") + F.substring("claim", 7, 1).cast("int")) % 4
    verdicts = claims.select("case_id", "pos", "claim", F.when(k == 0, "UNSUPPORTED").when(k == 1, "PARTIALLY_SUPPORTED").otherwise("SUPPORTED").alias("status"))
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("ambiguous_botanical"))).when(F.col("o_orderkey") % 11 == 1, F.array(F.lit("web_search_failed"))).when(F.col("o_orderkey") % 11 == 2, F.array(F.lit("section3_evidence_gap"))).otherwise(none).alias("reasons"), none.alias("stripped"))
    return evidence.verify_rollup(cases, verdicts, _lines(spark, sf_dir).where("l_discount > 0.01").select("case_id", "id"), ["web_search_failed"])


_ROLLUP = f"""{_CLAIMS}, v AS (SELECT case_id, pos, claim, (case_id + claim[7]::INT) % 4 AS k FROM claims), s AS (SELECT DISTINCT case_id FROM l WHERE l_discount > 0.01), g AS (SELECT case_id, count(*) AS n, count(*) FILTER (k <> 0) AS good, array_to_string(list(claim ORDER BY pos), '|') AS every, coalesce(array_to_string(list(claim ORDER BY pos) FILTER (k = 0), '|'), '') AS bad FROM v GROUP BY 1),
 c AS (SELECT o_orderkey AS case_id, s.case_id IS NULL AS none, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(every, '') AS every, coalesce(bad, '') AS bad, CASE o_orderkey % 11 WHEN 0 THEN 'ambiguous_botanical' WHEN 1 THEN 'web_search_failed' WHEN 2 THEN 'section3_evidence_gap' ELSE '' END AS r FROM orders LEFT JOIN s ON s.case_id = o_orderkey LEFT JOIN g ON g.case_id = o_orderkey),
 o AS (SELECT *, good / greatest(1, n) AS ratio, CASE WHEN none THEN every WHEN n = 0 THEN '' ELSE bad END AS stripped, r IN ('ambiguous_botanical', 'section3_evidence_gap') AS forced FROM c),
 p AS (SELECT *, CASE WHEN none THEN 'HUMAN_REVIEW_REQUIRED' WHEN n = 0 THEN 'PASS' WHEN forced THEN 'HUMAN_REVIEW_REQUIRED' WHEN stripped <> '' AND ratio < {evidence.MIN_SUPPORT} THEN 'FAIL' WHEN stripped <> '' THEN 'HUMAN_REVIEW_REQUIRED' ELSE 'PASS' END AS given,
  CASE WHEN none THEN 'missing_evidence' WHEN n = 0 OR forced THEN '' WHEN stripped <> '' AND ratio < {evidence.MIN_SUPPORT} THEN 'unsupported_claims' WHEN stripped <> '' THEN 'partial_unsupported_claims' ELSE '' END AS extra FROM o)"""


@query("verify_rollup", f"WITH {_ROLLUP} SELECT case_id, CASE WHEN given = 'PASS' AND r = 'web_search_failed' THEN 'HUMAN_REVIEW_REQUIRED' ELSE given END AS outcome, round(ratio, 6) AS support_ratio, stripped, array_to_string(list_filter([r, extra], lambda x: x <> ''), '|') AS reasons FROM p")
def verify_rollup(spark, sf_dir):
    return _rolled(spark, sf_dir).select("case_id", "outcome", F.round("support_ratio", 6).alias("support_ratio"), F.array_join("stripped", "|").alias("stripped"), F.array_join("reasons", "|").alias("reasons"))


@query("strip_claims", f"WITH {_CLAIMS}, t AS (SELECT case_id, string_agg(claim, chr(10) || chr(10) ORDER BY pos) AS draft, bool_or(claim = 'claim 3.') AS hit FROM claims GROUP BY 1), u AS (SELECT case_id, hit, regexp_replace(regexp_replace(replace(draft, 'claim 3.', ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS d FROM t) SELECT case_id, CASE WHEN hit THEN CASE WHEN d <> '' THEN d || chr(10) || chr(10) ELSE '' END || '{evidence.REMOVED_NOTICE}' ELSE d END AS cleaned FROM u")
def strip_claims(spark, sf_dir):
    claims = evidence.collect_claims(_claim(spark, sf_dir))
    drafts = claims.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim"))), lambda x: x["claim"]), "\n\n").alias("draft"), F.filter(F.collect_list("claim"), lambda c: c == "claim 3.").alias("stripped"))
    return drafts.select("case_id", evidence.strip_claims(F.col("draft"), F.col("stripped")).alias("cleaned"))


@query("ingredient_terms", "WITH i AS (SELECT o_orderkey AS case_id, o_orderstatus, list(' ' || (l_suppkey % 5) || ' ' ORDER BY l_linenumber, l_suppkey, l_partkey) FILTER (l_suppkey % 3 <> 0) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), d AS (SELECT case_id, o_orderstatus, x, list_transform(coalesce(x, []), lambda y: trim(y)) AS y FROM i) SELECT case_id, array_to_string(CASE WHEN len(y) > 0 THEN list_filter(y, lambda v, j: list_position(y, v) = j) WHEN o_orderstatus = 'F' THEN ['bot'] ELSE ['prod'] END, '|') AS terms FROM d")
def ingredient_terms(spark, sf_dir):
    rows = _lines(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("x"))
    rows = rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus"), "case_id")
    ing = F.transform(F.filter("x", lambda r: r["n"] % 3 != 0), lambda r: F.concat(F.lit(" "), (r["n"] % 5).cast("string"), F.lit(" ")))
    return rows.select("case_id", F.array_join(botanical.ingredient_terms(ing, F.when(F.col("o_orderstatus") == "F", "bot"), F.lit(" prod ")), "|").alias("terms"))


def _candidates(spark, sf_dir):
    from ..operators import kg

    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    amb = p.where("p_partkey % 40 = 0").groupBy(F.col("p_brand").alias("term")).agg(F.collect_list(name).alias("botanicals"))
    herbs = p.select(name.alias("botanical_name"), F.array("p_brand", "p_name").alias("names"), ((F.col("p_size") % 5 + 5) / 10).alias("confidence"), F.lit(None).cast("string").alias("family"), F.array("p_type").alias("compounds"))
    nodes, edges = kg.seed(herbs, amb, p.limit(0).select(F.col("p_name").alias("name"), F.array("p_name").alias("aliases"), F.col("p_name").alias("dosage_form"), F.array("p_name").alias("herbs")))
    nodes, edges = nodes.withColumn("origin", F.lit("curated")), edges.withColumn("origin", F.lit("curated"))
    terms = p.select(F.explode(F.array(F.upper("p_name"), F.col("p_brand"), F.lit("unknown"), name)).alias("term"))
    return terms, botanical.lookup(terms, nodes, edges)


_H = "h AS (SELECT p_name || ' ' || p_partkey AS name, p_name, p_brand, p_type, p_partkey, (p_size % 5 + 5) / 10 AS confidence FROM part), terms AS (SELECT DISTINCT unnest([upper(p_name), p_brand, 'unknown', name]) AS term FROM h), amb AS (SELECT DISTINCT lower(p_brand) AS term FROM h WHERE p_partkey % 40 = 0), cand AS (SELECT DISTINCT lower(t.term) AS term, h.* FROM terms t JOIN h ON (lower(t.term) IN (lower(h.name), lower(h.p_name)) OR (lower(t.term) = lower(h.p_brand) AND (h.p_partkey % 40 = 0 OR lower(h.p_brand) NOT IN (SELECT term FROM amb)))))"


@query("botanical_lookup", f"WITH {_H} SELECT term, name AS botanical_name, array_to_string([name, p_brand, p_name], '|') AS synonyms, p_type AS phytochemicals, confidence FROM cand")
def botanical_lookup(spark, sf_dir):
    return _candidates(spark, sf_dir)[1].select("term", "botanical_name", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("phytochemicals", "|").alias("phytochemicals"), "confidence")


@query("botanical_fallback", f"WITH {_H} SELECT term, count(*) AS n FROM (SELECT term FROM cand UNION ALL SELECT 'unknown') GROUP BY 1")
def botanical_fallback(spark, sf_dir):
    terms, found = _candidates(spark, sf_dir)
    second = spark.sql("SELECT t AS term, 'Second' AS botanical_name, array('Second') AS synonyms, array() AS phytochemicals, 0.9D AS confidence FROM (SELECT explode(array('unknown', 'brand#1', 'nowhere')) AS t)").withColumn("phytochemicals", F.array().cast("array<string>"))
    return botanical.with_fallback(terms, found, second).groupBy("term").agg(F.count("*").alias("n"))


_RES = f"{_H}, res AS (SELECT t.term, CASE WHEN count(c.name) > 1 THEN 'AMBIGUOUS' WHEN count(c.name) = 1 AND max(confidence) >= 0.7 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN count(c.name) = 1 THEN any_value(c.name) END AS botanical_name, coalesce(max(confidence), 0) AS confidence, count(c.name) AS n_candidates FROM terms t LEFT JOIN cand c ON c.term = lower(t.term) GROUP BY t.term)"


@query("resolve_botanicals", f"WITH {_RES} SELECT * FROM res")
def resolve_botanicals(spark, sf_dir):
    return botanical.resolve(*_candidates(spark, sf_dir))


@query("case_botanicals", f"WITH {_RES}, {_LINES}, ct AS (SELECT case_id, pos, CASE WHEN n % 2 = 0 THEN p_brand ELSE p_name || ' ' || p_partkey END AS term FROM l JOIN part ON l.l_partkey = p_partkey) SELECT case_id, arg_min(term, pos) AS primary_term, arg_min(status, pos) AS primary_status, bool_or(status = 'AMBIGUOUS') AS ambiguous, CASE WHEN bool_or(status = 'AMBIGUOUS') THEN 'ambiguous_botanical' ELSE '' END AS reasons FROM ct JOIN res USING (term) GROUP BY 1")
def case_botanicals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    ct = _lines(spark, sf_dir).join(p, F.col("l_partkey") == F.col("p_partkey")).select("case_id", "pos", F.when(F.col("n") % 2 == 0, F.col("p_brand")).otherwise(F.col("name")).alias("term"))
    return botanical.case_botanicals(ct, botanical.resolve(*_candidates(spark, sf_dir))).withColumn("reasons", F.array_join("reasons", "|"))


@query("identity_status", f"WITH {_RES} SELECT term, CASE WHEN status = 'AMBIGUOUS' THEN 'ambiguous' WHEN status = 'RESOLVED' AND confidence >= 0.8 THEN 'confirmed' WHEN status = 'RESOLVED' THEN 'probable' ELSE 'insufficient_evidence' END AS identity FROM res")
def identity_status(spark, sf_dir):
    return botanical.resolve(*_candidates(spark, sf_dir)).select("term", botanical.identity_status(F.col("status"), F.col("botanical_name"), F.col("confidence"), 0.8).alias("identity"))


@query("canonical_terms", f"WITH {_LINES}, t AS (SELECT case_id, pos, CASE l_linenumber % 3 WHEN 0 THEN ['b' || n, 's1', 's2'] WHEN 1 THEN [] ELSE ['u' || n % 4] END AS t FROM l), f AS (SELECT case_id, flatten(list(t ORDER BY pos)) AS f FROM t GROUP BY 1) SELECT case_id AS formulation_id, array_to_string(list_filter(f, lambda v, j: list_position(f, v) = j), '|') AS terms FROM f")
def canonical_terms(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    m, b = F.col("l_linenumber") % 3, F.concat(F.lit("b"), F.col("n").cast("string"))
    ing = rows.select(F.col("case_id").alias("formulation_id"), "pos", F.concat(F.lit("u"), (F.col("n") % 4).cast("string")).alias("user_term"), b.alias("botanical_name"), F.array(b, F.lit("s1"), F.lit("s2"), F.lit("s3")).alias("synonyms"), F.when(m == 0, "confirmed").when(m == 1, "ambiguous").otherwise("insufficient_evidence").alias("identity_status"))
    return botanical.canonical_terms(ing).withColumn("terms", F.array_join("terms", "|"))


@query("detect_script", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Deva' WHEN 1 THEN 'Taml' WHEN 2 THEN 'Arab' ELSE 'Latn' END AS script FROM documents")
def detect_script(spark, sf_dir):
    k = F.col("doc_id") % 4
    text = F.concat(F.substring("text", 1, 20), F.when(k == 0, "कखக").when(k == 1, "க क").when(k == 2, "ابक ").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", botanical.detect_script(text).alias("script"))
