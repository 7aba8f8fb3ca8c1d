"""Queries over formulation records and streams, with SQL where it can say the same.

Orders are formulations, their lines ingredients; events are the action log.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..operators import formulation as fm
from ..operators import kg, replay
from ..queries import query
from ..sources.store import read_parts, scratch, written
from ..streaming import jobs
from .adapters import sql_list, table

_UNITS = ["mg", "g", "mcg", "ml"]
_STATUS = ["confirmed", "probable", "ambiguous", "insufficient_evidence"]
_BRANCHES = ["regulatory", "abs", "traditional_knowledge", "patent"]


def _ingredients(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    li = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w))
    return li.select(
        F.col("l_orderkey").alias("formulation_id"), "pos", F.concat(F.lit("i"), "pos").alias("ingredient_id"), F.concat(F.lit("term "), (F.col("l_partkey") % 50).cast("string")).alias("user_term"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_quantity")).alias("quantity"), F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("unit"),
        F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("identity_status"), F.concat(F.lit("plant "), (F.col("l_partkey") % 30).cast("string")).alias("botanical_name"),
        F.when(F.col("l_returnflag") != "N", F.lower("l_returnflag")).alias("plant_part"),
    )


def _formulations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    null = F.lit(None).cast("string")
    return o.select(F.col("o_orderkey").alias("formulation_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("dosage_form"), F.col("o_orderpriority").alias("intended_use"), F.when(F.col("o_custkey") % 2 == 0, "research").alias("purpose"), F.when(F.col("o_custkey") % 3 == 0, "indian").alias("entity_type"), F.array(F.lit("a"), F.lit("b")).alias("product_claims"), null.alias("name"))


_ING = f"""i AS (SELECT l_orderkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS pos, 'term ' || l_partkey % 50 AS user_term, CASE WHEN l_suppkey % 10 <> 0 THEN l_quantity END AS quantity, {sql_list(_UNITS)}[l_linenumber % 4 + 1] AS unit, {sql_list(_STATUS)}[l_suppkey % 4 + 1] AS status, 'plant ' || l_partkey % 30 AS plant, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END AS part FROM lineitem)"""
_MG = "quantity * CASE unit WHEN 'mg' THEN 1 WHEN 'g' THEN 1000 WHEN 'mcg' THEN 0.001::DOUBLE END"
_CHAR = f"c AS (SELECT f, count(*) AS n, count({_MG}) AS known, sum({_MG}) AS s, count(*) FILTER (status IN ('confirmed', 'probable')) AS resolved, coalesce(array_to_string(list(DISTINCT part ORDER BY part) FILTER (part IS NOT NULL), '|'), '') AS parts FROM i GROUP BY f)"


def _shown(df):
    return df.select("formulation_id", "n", "composition", F.round("total_mg", 4).alias("total_mg"), "resolved", F.array_join("parts", "|").alias("parts"))


@query("characterize", f"WITH {_ING}, {_CHAR} SELECT o_orderkey AS formulation_id, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'Single-ingredient' WHEN n > 1 THEN 'Polyherbal (' || n || ' ingredients)' END AS composition, CASE WHEN known = n THEN round(s, 4) END AS total_mg, coalesce(resolved, 0) AS resolved, coalesce(parts, '') AS parts FROM orders LEFT JOIN c ON f = o_orderkey")
def characterize(spark, sf_dir):
    return _shown(fm.characterize(_formulations(spark, sf_dir), _ingredients(spark, sf_dir)))


@query("missing_information", f"WITH {_ING}, g AS (SELECT f, bool_or(quantity IS NULL) AS q, bool_or(status = 'ambiguous') AS a, bool_or(status = 'insufficient_evidence') AS u, arg_min(user_term, pos) FILTER (status = 'ambiguous') AS t FROM i GROUP BY f) SELECT o_orderkey AS formulation_id, array_to_string(list_filter([CASE WHEN f IS NULL THEN 'ingredients' END, CASE WHEN q THEN 'quantities' END, CASE WHEN o_orderstatus = 'P' THEN 'dosage_form' END, CASE WHEN a THEN 'ambiguous_identity' END, CASE WHEN u THEN 'unresolved_identity' END], lambda x: x IS NOT NULL), '|') AS missing, CASE WHEN f IS NULL THEN 'ingredients' WHEN a THEN 'identity:' || t WHEN o_custkey % 2 <> 0 THEN 'purpose' WHEN o_custkey % 3 <> 0 THEN 'entity_type' END AS question FROM orders LEFT JOIN g ON f = o_orderkey")
def missing_information(spark, sf_dir):
    return fm.missing_information(_formulations(spark, sf_dir), _ingredients(spark, sf_dir)).withColumn("missing", F.array_join("missing", "|"))


@query("tool_readiness", f"""WITH {_ING}, g AS (SELECT f, arg_min(struct_pack(i := 'i' || pos, c := 'plant ' || pos), pos) FILTER (status = 'ambiguous' AND pos % 2 = 0) AS o FROM i GROUP BY f), t AS (SELECT unnest(['patent', 'nba-abs']) AS tool),
 r AS (SELECT o_orderkey AS k, tool, f IS NULL AS none, o, tool = 'nba-abs' AND o_custkey % 2 <> 0 AS p, tool = 'nba-abs' AND o_custkey % 3 <> 0 AS e FROM orders CROSS JOIN t LEFT JOIN g ON f = o_orderkey),
 q AS (SELECT *, CASE WHEN none THEN 'ingredients' WHEN o IS NOT NULL THEN 'botanical_identity' WHEN p THEN 'purpose' WHEN e THEN 'entity_type' END AS question FROM r)
 SELECT k AS formulation_id, tool, question IS NULL AS ready, array_to_string(list_filter([CASE WHEN none THEN 'ingredients' END, CASE WHEN p THEN 'purpose' END, CASE WHEN e THEN 'entity_type' END], lambda x: x IS NOT NULL), '|') AS missing, question, CASE WHEN question = 'botanical_identity' THEN o.i END AS ingredient_id, CASE question WHEN 'botanical_identity' THEN o.c || '|other' WHEN 'purpose' THEN 'commercial_utilization|research|bio_survey|ipr' WHEN 'entity_type' THEN 'indian|foreign' END AS options FROM q""")
def tool_readiness(spark, sf_dir):
    ing = _ingredients(spark, sf_dir).withColumn("candidates", F.when(F.col("pos") % 2 == 0, F.array(F.concat(F.lit("plant "), "pos"), F.lit("other"))))
    tools = [fm.tool_readiness(_formulations(spark, sf_dir), ing, tool) for tool in ("patent", "nba-abs")]
    return tools[0].unionByName(tools[1]).withColumns({"missing": F.array_join("missing", "|"), "options": F.array_join("options", "|")})


def _claims(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    branch = F.element_at(F.array(*map(F.lit, _BRANCHES)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    hits = li.select(F.col("l_orderkey").alias("formulation_id"), branch.alias("branch"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("rank"), F.concat(F.lit("s"), "l_suppkey").alias("id"))
    return fm.formulation_claims(_formulations(spark, sf_dir), _ingredients(spark, sf_dir), hits)


_PLANTS = "p AS (SELECT * FROM i WHERE status IN ('confirmed', 'probable'))"
_CLAIMS = f"""{_ING}, {_PLANTS}, r AS (SELECT o_orderkey AS f, '{fm.LICENCE_CLAIM}' AS claim, 'regulatory' AS branch, 'regulatory' AS s, 0 AS ord FROM orders
 UNION ALL SELECT f, '{fm.RESOURCE_CLAIM}', 'abs', 'bio:i' || pos, pos FROM p UNION ALL SELECT DISTINCT f, '{fm.ACCESS_CLAIM}', 'abs', 'abs', 0 FROM p
 UNION ALL SELECT DISTINCT f, plant || '{fm.TRADITION_CLAIM}', 'traditional_knowledge', 'traditional_knowledge', 0 FROM p UNION ALL SELECT DISTINCT f, '{fm.PRIOR_ART_CLAIM}' || plant || '.', 'patent', 'prior_art', 0 FROM p),
 m AS (SELECT f, claim, any_value(branch) AS branch, array_to_string(list(s ORDER BY ord), '|') AS subjects FROM r GROUP BY ALL),
 h AS (SELECT l_orderkey AS f, {sql_list(_BRANCHES)}[l_suppkey % 4 + 1] AS branch, list('s' || l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS c, array_to_string(c, '|') AS candidates FROM lineitem GROUP BY ALL)"""


@query("formulation_claims", f"WITH {_CLAIMS} SELECT m.f AS formulation_id, claim, m.branch, subjects, coalesce(candidates, '') AS candidates FROM m LEFT JOIN h ON h.f = m.f AND h.branch = m.branch")
def formulation_claims(spark, sf_dir):
    c = _claims(spark, sf_dir)
    return c.select("formulation_id", "claim", "branch", F.array_join("subject_ids", "|").alias("subjects"), F.array_join("candidate_ids", "|").alias("candidates"))


_VERDICT = "(length(claim) + m.f) % 5"
_EVIDENCE = f"""{_CLAIMS}, v AS (SELECT m.f, m.claim, string_split(m.subjects, '|') AS subjects, coalesce(c, []) AS c, CASE WHEN {_VERDICT} < 4 THEN coalesce(c, [])[1:2] ELSE [] END AS cited, CASE {_VERDICT} WHEN 0 THEN 'UNSUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 4 THEN NULL ELSE 'SUPPORTED' END AS verdict FROM m LEFT JOIN h ON h.f = m.f AND h.branch = m.branch),
 g AS (SELECT *, coalesce(verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED') AND len(cited) > 0, false) AS good, bool_or(verdict IS NOT NULL) OVER (PARTITION BY f) AS ran FROM v),
 sub AS (SELECT f, unnest(subjects) AS s, good, verdict FROM g), src AS (SELECT f, src, good AND list_contains(cited, src) AS uses, verdict, ran FROM (SELECT f, unnest(list_distinct(c)) AS src, cited, good, verdict, ran FROM g))"""


@query("claim_evidence", f"""WITH {_EVIDENCE} SELECT f AS formulation_id, s AS subject_id, CASE WHEN count(*) FILTER (good) = 0 THEN 'insufficient_evidence' WHEN count(*) FILTER (good AND verdict = 'SUPPORTED') = count(*) THEN 'confirmed' ELSE 'probable' END AS status, 'subject' AS kind FROM sub GROUP BY ALL
 UNION ALL SELECT f, src, CASE WHEN bool_or(uses AND verdict = 'SUPPORTED') THEN 'SUPPORTED' WHEN bool_or(uses AND verdict = 'PARTIALLY_SUPPORTED') THEN 'PARTIALLY_SUPPORTED' WHEN bool_or(ran) THEN 'UNSUPPORTED' ELSE 'NOT_VERIFIED' END, 'source' FROM src GROUP BY ALL
 UNION ALL SELECT DISTINCT f, s, src, 'supported_by' FROM (SELECT f, s, unnest(cited) AS src FROM (SELECT f, unnest(subjects) AS s, cited FROM g WHERE good))""")
def claim_evidence(spark, sf_dir):
    """Statuses of subjects and sources, and the edges between them (``status`` is then the source)."""
    claims = written(_claims(spark, sf_dir), "claims")  # verdicts are made of them
    k = (F.length("claim") + F.col("formulation_id")) % 5
    verdicts = claims.where(k != 4).select("formulation_id", F.upper("claim").alias("claim"), F.when(k == 0, "UNSUPPORTED").when(k == 1, "PARTIALLY_SUPPORTED").otherwise("SUPPORTED").alias("status"), F.slice("candidate_ids", 1, 2).alias("evidence_source_ids"))
    subjects, sources, edges = fm.claim_evidence(claims, verdicts)
    return subjects.withColumn("kind", F.lit("subject")).union(sources.withColumn("kind", F.lit("source"))).union(edges.withColumn("kind", F.lit("supported_by")))


@query("scenario_overlay", f"WITH {_ING}, n AS (SELECT * REPLACE (CASE WHEN pos = 1 THEN 5.0 ELSE quantity END AS quantity, CASE WHEN pos = 1 THEN 'mg' ELSE unit END AS unit) FROM i), c AS (SELECT f, count(*) AS n, count({_MG}) AS known, sum({_MG}) AS s FROM n GROUP BY f), d AS (SELECT f, count(*) AS changed FROM i WHERE pos = 1 AND (quantity IS NULL OR quantity <> 5 OR unit <> 'mg') GROUP BY f) SELECT c.f AS formulation_id, CASE WHEN known = n THEN round(s, 4) END AS total_mg, coalesce(changed, 0) AS changed FROM c LEFT JOIN d ON d.f = c.f")
def scenario_overlay(spark, sf_dir):
    ing = _ingredients(spark, sf_dir)
    overlay = ing.where("pos = 1").select("formulation_id", "ingredient_id", F.lit(5.0).alias("new_quantity"), F.lit("mg").alias("new_unit"))
    chars, diffs = fm.scenario_overlay(_formulations(spark, sf_dir), ing, overlay)
    changed = diffs.groupBy("formulation_id").agg(F.count("*").alias("changed"))
    return chars.where("n > 0").join(changed, "formulation_id", "left").select("formulation_id", F.round("total_mg", 4).alias("total_mg"), F.coalesce("changed", F.lit(0)).alias("changed"))


def _actions(spark, sf_dir):
    """The event log as actions: by kind of event and value, ordered within a user."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = ["ADD_INGREDIENT", "ADD_INGREDIENT", "UPDATE_INGREDIENT", "REMOVE_INGREDIENT", "UPDATE_FIELD", "UPDATE_CLAIMS", "UPDATE_DOSAGE_FORM", "CONFIRM_FORMULATION", "RESOLVE_ENTITY", "UNKNOWN"]
    k, null = F.col("event_id") % 12, F.lit(None).cast("string")
    ing = F.concat(F.lit("i"), (F.col("event_id") % 5).cast("string"))
    return e.withColumn("seq", F.row_number().over(order).cast("long")).select(
        F.col("user_id").alias("formulation_id"), "seq", F.when(F.col("event_id") % 17 == 0, F.lit(1)).cast("int").alias("base_version"), F.coalesce(F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 10).cast("int")), F.lit("UNKNOWN")).alias("type"),
        ing.alias("ingredient_id"), F.concat(F.lit("term "), ing).alias("user_term"), F.round("value", 2).alias("quantity"), F.lit("mg").alias("unit"), null.alias("plant_part"),
        F.when(k < 6, F.concat(F.lit("plant "), (F.col("event_id") % 7).cast("string"))).alias("botanical_name"), F.when(k % 2 == 0, "purpose").otherwise("name").alias("field"), F.when(k % 3 == 0, "research").otherwise(F.col("event_type")).alias("value"), F.array("event_type").alias("claims"),
        F.array(F.concat(F.lit("Syn "), (F.col("event_id") % 3).cast("string"))).alias("synonyms"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.concat(F.lit("plant "), i.cast("string")).alias("botanical_name"), F.array(F.concat(F.lit("other "), i.cast("string"))).alias("synonyms"))).alias("candidates"),
    )


@query("replay_actions")
def replay_actions(spark, sf_dir):
    return replay.replay_actions(_actions(spark, sf_dir))


@query("replay_stream")
def replay_stream(spark, sf_dir):
    base = scratch(spark, "replay")
    actions = _actions(spark, sf_dir)
    actions.write.parquet(f"{base}/in")
    jobs.replay_job(spark, spark.readStream.schema(actions.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("version_diff")
def version_diff(spark, sf_dir):
    return fm.version_diff(replay.versions(replay.replay_actions(_actions(spark, sf_dir))))


def _texts(spark, sf_dir):
    """All turns, each with a request in front."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", F.concat(F.element_at(F.array(*map(F.lit, _REQUESTS)), (F.col("turn") % len(_REQUESTS) + 1).cast("int")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


_LEXICON = ["tulsi", "holy tulsi", "neem", "ashwagandha"]
_REQUESTS = [
    "please add 500 mg of Tulsi leaf and neem bark (20 g) to the capsules and check patents.",
    "/abs what now",
    "what if holy tulsi is 5 g instead, for better sleep?",
    "remove x-tulsi and 30 ml syrup, 40 mg honey; is it patentable for an Indian company doing research",
    "show the abs branch: why does it matter?",
    "why is biodiversity relevant, what is the evidence",
    "zzz",
]


@query("extract_ingredients")
def extract_ingredients(spark, sf_dir):
    return ex.extract_ingredients(_texts(spark, sf_dir), _LEXICON)


_TEXTS_SQL = f"(SELECT conv_id * 100 + turn AS id, {sql_list(_REQUESTS)}[turn % {len(_REQUESTS)} + 1] || chr(10) || coalesce(text, '') AS text FROM conversations)"


@query(
    "ground_extraction",
    rf"""WITH t AS (SELECT id, lower(text) AS t FROM {_TEXTS_SQL}), g AS (SELECT unnest([1, 2, 3]) AS pos)
 SELECT id, pos, CASE pos WHEN 1 THEN CASE WHEN regexp_matches(t, '(^|[^\d.])500($|\D)') THEN 500.0 END WHEN 2 THEN CASE WHEN regexp_matches(t, '(^|[^\d.])(987654321\.5|9\.87654e\+08)($|\D)') THEN 987654321.5 END END::DOUBLE AS quantity,
  contains(t, ['tulsi', 'neem', 'xyzzy'][pos]) AS kept, CASE pos WHEN 1 THEN CASE WHEN contains(t, 'leaf') THEN 'leaf' END WHEN 2 THEN CASE WHEN contains(t, 'bark') THEN 'bark' END END AS plant_part FROM t, g""",
)
def ground_extraction(spark, sf_dir):
    t = _texts(spark, sf_dir)
    given = [(1, "Tulsi leaf", 500.0, "mg"), (2, "bark of neem", 987654321.5, "g"), (3, "xyzzy", None, "g")]
    items = F.array(*[F.struct(F.lit(pos).alias("pos"), F.lit(term).alias("user_term"), F.lit(q).cast("double").alias("quantity"), F.lit(u).alias("unit"), F.lit(None).cast("string").alias("plant_part")) for pos, term, q, u in given])
    return ex.ground_extraction(t.select("id", F.explode(items).alias("i")).select("id", "i.*"), t.select("id", "text")).select("id", "pos", "quantity", "kept", "plant_part")


def _holds(pattern: str) -> str:
    return f"regexp_matches(t, '(?i){pattern}')"


def _place(pattern: str) -> str:
    """Where the first match of a pattern begins, or null."""
    return f"CASE WHEN {_holds(pattern)} THEN length(regexp_split_to_array(t, '(?i){pattern}')[1]) + 1 END"


_ANY_FORM = r"\b(?:" + "|".join(ex.DOSAGE_FORMS) + r")\b"
_WORDS = sql_list([*ex.NO_INGREDIENT, *ex.DOSAGE_FORMS])
_PASSIVE = f"({_holds(ex.INTENTS['SHOW_DECISION_PATH'])} OR {_holds(ex.GRAPH_VIEW)} OR ({_holds(ex.INTENTS['VIEW_EVIDENCE'])} AND NOT {_holds(ex.ACTION)}))"
_SEEN = ", ".join(f"CASE WHEN {_place(p)} IS NOT NULL{' AND named' if k == 'RESOLVE_AMBIGUITY' else ''} THEN lpad(CAST({_place(p)} AS VARCHAR), 9, '0') || lpad('{i}', 2, '0') || '{k}' END" for i, (k, p) in enumerate(ex.INTENTS.items()) if k != "SCENARIO")
_COMMAND = "CASE lower(regexp_extract(t, '^(\\S+)', 1)) " + " ".join(f"WHEN '{c}' THEN '{i}'" for c, i in ex.COMMANDS.items()) + " END"


def _first_sql(patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {_holds(p)} THEN '{v}'" for v, p in patterns.items()) + " END"


_USE = r"regexp_replace(regexp_extract(regexp_replace({}, '(?i)\bfor(\s+the\s+(?:patent|abs|review)\b)', 'f0r\1', 'g'), '(?i)\bfor\s+([^\n]{{2,120}})', 1), '(?is)\s*(?:[.?!;]|,?\s+(?:then|and then|and check|check|can i|could you|please|also)\b).*$', '')"
_WORD_OF = lambda words: "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)\\b{w}\\b') THEN '{v}'" for w, v in words.items()) + " ELSE '' END"


@query(
    "extract_header",
    rf"""WITH h AS (SELECT id, text, trim({_USE.format("text")}, ' ,') AS use FROM {_TEXTS_SQL})
 SELECT id, regexp_replace(regexp_extract(text, '{ex.NAME[4:].replace("'", "''")}', 1), '^\s+|\s+$', '', 'g') AS name, {_WORD_OF(ex.DOSAGE_FORMS)} AS dosage_form, {_WORD_OF({r: r for r in ex.ROUTES})} AS route, CASE WHEN regexp_matches(use, '{ex.NO_USE}') THEN '' ELSE use END AS intended_use FROM h""",
)
def extract_header(spark, sf_dir):
    return ex.extract_header(_texts(spark, sf_dir))


@query(
    "tag_intents",
    rf"""WITH t AS (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {_TEXTS_SQL}),
 u AS (SELECT id, t, regexp_replace(regexp_extract(regexp_replace(t, '(?i)\bfor(\s+the\s+(?:patent|abs|review)\b)', 'f0r\1', 'g'), '(?i)\bfor\s+([^\n]{{2,120}})', 1), '(?is)\s*(?:[.?!;]|,?\s+(?:then|and then|and check|check|can i|could you|please|also)\b).*$', '') AS use,
   regexp_matches(t, '(?i)(^|[^\pL\pN\pM_-])({"|".join(_LEXICON)})($|[^\pL\pN\pM_-])') OR len(list_filter(regexp_extract_all(t, '(?i){ex.QUANTIFIED}', 3), lambda w: NOT list_contains({_WORDS}, lower(w)))) > 0 AS named FROM t),
 h AS (SELECT *, {_holds(_ANY_FORM)} AS form, trim(use, ' ,') <> '' AND NOT regexp_matches(trim(use, ' ,'), '{ex.NO_USE}') AS used, {_holds(ex.REMOVE)} AS remove, NOT {_holds(ex.REMOVE)} AND {_holds(ex.UPDATE)} AND NOT {_holds(ex.ADD)} AS only_update, {_COMMAND} AS command FROM u),
 f AS (SELECT *, CASE WHEN {_holds(ex.INTENTS["SCENARIO"])} THEN ['SCENARIO'] ELSE list_filter([CASE WHEN named AND NOT remove AND NOT only_update THEN 'CREATE_FORMULATION' END, CASE WHEN remove THEN 'REMOVE_INGREDIENT' END, CASE WHEN named AND only_update THEN 'UPDATE_QUANTITY' END, CASE WHEN form THEN 'UPDATE_DOSAGE_FORM' END, CASE WHEN used THEN 'UPDATE_INTENDED_USE' END], lambda x: x IS NOT NULL) END
   || list_transform(list_sort(list_filter([{_SEEN}], lambda x: x IS NOT NULL)), lambda x: x[12:]) || CASE WHEN {_holds(ex.GRAPH_VIEW)} THEN ['SHOW_DECISION_PATH'] ELSE [] END AS every FROM h),
 e AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i AND NOT ({_PASSIVE} AND list_contains({sql_list(ex.TOOLS)}, x))) AS kept FROM f)
 SELECT id, CASE WHEN command IS NOT NULL THEN command WHEN len(kept) > 0 THEN array_to_string(kept, '|') ELSE 'GENERAL_QUESTION' END AS intents, CASE WHEN command IS NOT NULL THEN 'command' ELSE 'rules' END AS decoder,
  CASE WHEN command IS NULL THEN {_first_sql(ex.PURPOSES)} END AS purpose, CASE WHEN command IS NULL THEN {_first_sql(ex.ENTITIES)} END AS entity_type,
  CASE WHEN command IS NULL AND ({_holds(ex.INTENTS["SHOW_DECISION_PATH"])} OR {_holds(ex.GRAPH_VIEW)}) THEN coalesce(nullif(lower(regexp_extract(t, '(?i){ex.GRAPH_VIEW}', 1)), ''), CASE WHEN {_holds(r"\babs\b|\bbiodiversity\b")} THEN 'abs' WHEN {_holds("patent")} THEN 'patent' END) END AS graph_filter FROM e""",
)
def tag_intents(spark, sf_dir):
    t = _texts(spark, sf_dir)
    has = ex.extract_ingredients(t, _LEXICON).select("id").distinct().withColumn("has", F.lit(True))
    rows = t.join(ex.extract_header(t), "id").join(has, "id", "left")
    tags = ex.tag_intents(F.col("text"), F.col("has"), F.col("dosage_form"), F.col("intended_use"))
    return rows.select("id", tags.alias("t")).select("id", F.array_join("t.intents", "|").alias("intents"), "t.decoder", "t.purpose", "t.entity_type", "t.graph_filter")


@query("stream_index_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents")
def stream_index_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").cast("string").alias("id"), F.lit("old").alias("state"))
    base = scratch(spark, "index")
    d.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("new").alias("state"), F.col("doc_id").alias("seq")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id string, state string, seq long").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    out = jobs.upsert_job(stream, old, jobs.index_upsert, f"{base}/out", f"{base}/checkpoint")
    return read_parts(spark, out).select(F.col("id").cast("long").alias("doc_id"), "state")


@query("stream_kg_upsert", "SELECT 'Herb:' || lower(p_name || ' ' || p_partkey) AS key, p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|seen' ELSE p_brand END AS aliases, 'curated' AS origin FROM part UNION ALL SELECT 'Product:' || lower(s_name), s_name, '', 'pipeline' FROM supplier")
def stream_kg_upsert(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    old = kg.node_rows(p, "Herb", name, F.array("p_brand")).withColumn("origin", F.lit("curated"))
    batch = kg.node_rows(p.where("p_partkey % 2 = 0"), "Herb", F.upper(name), F.array(F.lit("seen"))).unionByName(kg.node_rows(s, "Product", F.col("s_name")))
    base = scratch(spark, "kg")
    batch.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    out = jobs.upsert_job(stream, old, jobs.kg_node_upsert, f"{base}/out", f"{base}/checkpoint", "key")
    return read_parts(spark, out).select("key", "name", F.array_join("aliases", "|").alias("aliases"), "origin")
