"""Formulation records: characteristics, gaps, claims and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.store import written_in_buckets

# Mass units in milligrams and units that are known.
TO_MG = {"mg": 1.0, "g": 1000.0, "kg": 1_000_000.0, "mcg": 0.001}
UNITS = ["mg", "g", "kg", "mcg", "ml", "l", "%", "iu", "part", "tablet", "capsule"]
HEADER = ["name", "dosage_form", "route", "intended_use", "target_market", "purpose", "entity_type"]
RESOLVED = ["confirmed", "probable"]
FEE_FIELDS = {"purpose": ["commercial_utilization", "research", "bio_survey", "ipr"], "entity_type": ["indian", "foreign"]}
# The texts of claims.
RESOURCE_CLAIM = "Plants and plant parts are biological resources under the Biological Diversity Act, 2002."
LICENCE_CLAIM = "Manufacture of Ayurvedic drugs for sale in India requires a licence under the Drugs and Cosmetics Act, 1940."
ACCESS_CLAIM = "Obtaining biological resources occurring in India for commercial utilization requires prior intimation or approval under the Biological Diversity Act."
TRADITION_CLAIM = " is described in Ayurvedic pharmacopoeial or classical formulary texts."
PRIOR_ART_CLAIM = "Patent documents disclose compositions containing "


def characterize(formulations: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(formulation_id, n, composition, total_mg, resolved, parts, n_claims); total_mg only if all masses are known."""
    mg = F.create_map(*[x for k, v in TO_MG.items() for x in (F.lit(k), F.lit(v))])
    mass = F.col("quantity") * F.try_element_at(mg, F.col("unit"))
    rows = ingredients.groupBy("formulation_id").agg(
        F.count("*").alias("n"),
        F.count(mass).alias("known"),
        F.sum(mass).alias("sum"),
        F.count_if(F.col("identity_status").isin(RESOLVED)).alias("resolved"),
        F.sort_array(F.collect_set(F.when(F.col("plant_part") != "", F.col("plant_part")))).alias("parts"),
    )
    out = formulations.join(rows, "formulation_id", "left")
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 1, "Single-ingredient").when(n > 1, F.concat(F.lit("Polyherbal ("), n.cast("string"), F.lit(" ingredients)")))
    return out.select("formulation_id", n.alias("n"), kind.alias("composition"), F.when((n > 0) & (F.col("known") == n), F.col("sum")).alias("total_mg"), F.coalesce("resolved", F.lit(0)).alias("resolved"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"), F.size(F.coalesce("product_claims", F.array().cast("array<string>"))).alias("n_claims"))


def missing_information(formulations: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(formulation_id, missing, question): what is missing, and the first question that blocks the fee tool."""
    rows = ingredients.groupBy("formulation_id").agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("quantity").isNull()).alias("no_quantity"),
        F.bool_or(F.col("identity_status") == "ambiguous").alias("ambiguous"),
        F.bool_or(F.col("identity_status") == "insufficient_evidence").alias("unresolved"),
        F.min_by("user_term", F.when(F.col("identity_status") == "ambiguous", F.col("pos"))).alias("first_ambiguous"),
    )
    out = formulations.join(rows, "formulation_id", "left")
    none = F.coalesce("n", F.lit(0)) == 0

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    flags = [(none, "ingredients"), (F.col("no_quantity"), "quantities"), (blank("dosage_form"), "dosage_form"), (blank("intended_use"), "intended_use"), (F.col("ambiguous"), "ambiguous_identity"), (F.col("unresolved"), "unresolved_identity")]
    missing = F.array_compact(F.array(*[F.when(F.coalesce(flag, F.lit(False)), word) for flag, word in flags]))
    question = F.coalesce(F.when(none, "ingredients"), F.when(F.coalesce("ambiguous", F.lit(False)), F.concat(F.lit("identity:"), "first_ambiguous")), F.when(F.col("purpose").isNull(), "purpose"), F.when(F.col("entity_type").isNull(), "entity_type"))
    return out.select("formulation_id", missing.alias("missing"), question.alias("question"))


def tool_readiness(formulations: DataFrame, ingredients: DataFrame, tool: str) -> DataFrame:
    """(formulation_id, tool, ready, missing, question, ingredient_id, options): what stops a tool, and the first question to ask.

    Tools are review, patent and nba-abs; only the last needs a purpose and an entity
    type.  An ambiguous identity is asked for only if it has candidates.
    ingredients: formulation_id, pos, ingredient_id, identity_status, candidates (array of names).
    """
    open_ = (F.col("identity_status") == "ambiguous") & (F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 0)
    rows = ingredients.groupBy("formulation_id").agg(F.count("*").alias("n"), F.min(F.when(open_, F.struct("pos", "ingredient_id", "candidates"))).alias("_open"))
    out = formulations.join(rows, "formulation_id", "left")
    needed = [(F.coalesce("n", F.lit(0)) == 0, "ingredients", None)]
    if tool == "nba-abs":
        needed += [(F.col(c).isNull(), c, values) for c, values in FEE_FIELDS.items()]
    missing = F.array_compact(F.array(*[F.when(flag, word) for flag, word, _ in needed]))
    (none, *fields), asks = needed, F.col("_open").isNotNull()
    question = F.coalesce(F.when(none[0], "ingredients"), F.when(asks, "botanical_identity"), *[F.when(flag, word) for flag, word, _ in fields])
    options = F.coalesce(F.when(asks & ~none[0], F.col("_open.candidates")), *[F.when(question == word, F.array(*map(F.lit, values))) for _, word, values in fields])
    return out.select("formulation_id", F.lit(tool).alias("tool"), question.isNull().alias("ready"), missing.alias("missing"), question.alias("question"), F.when(question == "botanical_identity", F.col("_open.ingredient_id")).alias("ingredient_id"), options.alias("options"))


def formulation_claims(formulations: DataFrame, ingredients: DataFrame, hits: DataFrame) -> DataFrame:
    """(formulation_id, claim, branch, subject_ids, candidate_ids).

    The licence claim always; with a resolved plant the resource claim, about each of
    them, and the access claim; for each resolved plant one about traditional
    knowledge and one about prior art.  Equal texts are one claim with all
    subjects.  Candidates are the hits of the claim's branch.  hits:
    formulation_id, branch, rank, id.
    """
    plants = ingredients.where(F.col("identity_status").isin(RESOLVED) & F.coalesce(F.col("botanical_name") != "", F.lit(False)))
    name, shown = F.col("botanical_name"), []
    for order, (claim, branch, subject) in enumerate(
        [
            (F.lit(RESOURCE_CLAIM), "abs", F.concat(F.lit("bio:"), "ingredient_id")),
            (F.lit(ACCESS_CLAIM), "abs", F.lit("abs")),
            (F.concat(name, F.lit(TRADITION_CLAIM)), "traditional_knowledge", F.lit("traditional_knowledge")),
            (F.concat(F.lit(PRIOR_ART_CLAIM), name, F.lit(".")), "patent", F.lit("prior_art")),
        ]
    ):
        shown.append(F.struct(claim.alias("claim"), F.lit(branch).alias("branch"), subject.cast("string").alias("subject"), F.lit(order).alias("order")))
    each = plants.select("formulation_id", "pos", F.explode(F.array(*shown)).alias("c")).select("formulation_id", "pos", "c.*")
    licence = formulations.select("formulation_id", F.lit(0).alias("pos"), F.lit(LICENCE_CLAIM).alias("claim"), F.lit("regulatory").alias("branch"), F.lit("regulatory").alias("subject"), F.lit(0).alias("order"))
    rows = each.withColumn("pos", F.col("pos").cast("int")).unionByName(licence)
    merged = rows.groupBy("formulation_id", "claim").agg(F.min_by("branch", "order").alias("branch"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "subject"))), lambda x: x["subject"])).alias("subject_ids"))
    found = hits.groupBy("formulation_id", "branch").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("candidate_ids"))
    return merged.join(found, ["formulation_id", "branch"], "left").withColumn("candidate_ids", F.coalesce("candidate_ids", F.array().cast("array<string>")))


def _claim_key(claim: Column) -> Column:
    return F.regexp_replace(normalize(claim), r"\.+$", "")


def claim_evidence(claims: DataFrame, verdicts: DataFrame, stripped: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subject statuses (formulation_id, subject_id, status), source statuses (formulation_id, source_id, status) and supported_by edges (formulation_id, subject_id, source_id).

    claims: formulation_id, claim, subject_ids, candidate_ids; verdicts:
    formulation_id, claim, status, evidence_source_ids; stripped: formulation_id,
    claim of those taken out as unsupported.  A claim is traceable if it is
    supported and cites a candidate of its own.  Formulations without any verdict
    are not verified.
    """
    none = F.array().cast("array<string>")
    given = verdicts.select("formulation_id", _claim_key(F.col("claim")).alias("_c"), F.col("status").alias("verdict"), "evidence_source_ids").dropDuplicates(["formulation_id", "_c"])
    if stripped is not None:
        given = given.join(stripped.select("formulation_id", _claim_key(F.col("claim")).alias("_c")), ["formulation_id", "_c"], "left_anti")
    ran = verdicts.select("formulation_id").distinct().withColumn("ran", F.lit(True))
    rows = claims.withColumn("_c", _claim_key(F.col("claim"))).join(given, ["formulation_id", "_c"], "left").join(ran, "formulation_id", "left")
    rows = rows.withColumn("cited", F.array_intersect("candidate_ids", F.coalesce("evidence_source_ids", none)))
    rows = rows.withColumn("good", F.coalesce(F.col("verdict").isin("SUPPORTED", "PARTIALLY_SUPPORTED") & (F.size("cited") > 0), F.lit(False)))
    # Written once, by formulation: what follows groups within one and shuffles nothing.
    rows = written_in_buckets(rows.select("formulation_id", "subject_ids", "candidate_ids", "verdict", "ran", "cited", "good"), "claims", "formulation_id")
    subjects = rows.select("formulation_id", F.explode("subject_ids").alias("subject_id"), "good", "verdict", "cited")
    counted = subjects.groupBy("formulation_id", "subject_id").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if(F.col("good") & (F.col("verdict") == "SUPPORTED")).alias("full"))
    status = F.when(F.col("good") == 0, "insufficient_evidence").when(F.col("full") == F.col("n"), "confirmed").otherwise("probable")
    edges = subjects.where("good").select("formulation_id", "subject_id", F.explode("cited").alias("source_id")).distinct()
    sources = rows.select("formulation_id", F.explode("candidate_ids").alias("source_id"), F.when(F.col("good"), F.col("cited")).otherwise(none).alias("cited"), "verdict", "ran").withColumn("uses", F.array_contains("cited", F.col("source_id")))
    by = sources.groupBy("formulation_id", "source_id").agg(F.bool_or(F.col("uses") & (F.col("verdict") == "SUPPORTED")).alias("s"), F.bool_or(F.col("uses") & (F.col("verdict") == "PARTIALLY_SUPPORTED")).alias("p"), F.bool_or("ran").alias("v"))
    state = F.when(F.col("s"), "SUPPORTED").when(F.col("p"), "PARTIALLY_SUPPORTED").when(F.col("v"), "UNSUPPORTED").otherwise("NOT_VERIFIED")
    return counted.select("formulation_id", "subject_id", status.alias("status")), by.select("formulation_id", "source_id", state.alias("status")), edges


def _amount(q: Column, u: Column) -> Column:
    return F.when(q.isNull(), "no quantity").otherwise(F.trim(F.concat(F.regexp_replace(q.cast("string"), r"\.0$", ""), F.lit(" "), F.coalesce(u, F.lit("")))))


def _identity(side: str) -> Column:
    return F.coalesce(F.nullif(f"{side}_botanical_name", F.lit("")), F.col(f"{side}_identity_status"))


def ingredient_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(keys..., kind, change) between ingredients of two versions, joined by (formulation_id, version, id).

    ``version`` is the newer version on both sides.
    """
    keys = ["formulation_id", "version", "id"]
    fields = ["user_term", "quantity", "unit", "plant_part", "botanical_name", "identity_status"]
    a = old.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = new.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    rows = a.join(b, keys, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def differs(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out |= ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
        return both & out

    def arrow(x: Column, y: Column, head: Column) -> Column:
        return F.concat(head, F.coalesce(x, F.lit("—")), F.lit(" → "), F.coalesce(y, F.lit("—")))

    term = F.col("b_user_term")
    changes = F.array_compact(
        F.array(
            F.when(F.col("in_a").isNull(), F.struct(F.lit("added").alias("kind"), F.concat(F.lit("Added "), term, F.lit(" ("), _amount(F.col("b_quantity"), F.col("b_unit")), F.lit(")")).alias("change"))),
            F.when(F.col("in_b").isNull(), F.struct(F.lit("removed").alias("kind"), F.concat(F.lit("Removed "), "a_user_term").alias("change"))),
            F.when(differs("quantity", "unit"), F.struct(F.lit("quantity").alias("kind"), arrow(_amount(F.col("a_quantity"), F.col("a_unit")), _amount(F.col("b_quantity"), F.col("b_unit")), F.concat(term, F.lit(": "))).alias("change"))),
            F.when(differs("user_term"), F.struct(F.lit("renamed").alias("kind"), arrow(F.col("a_user_term"), term, F.lit("Renamed ")).alias("change"))),
            F.when(differs("plant_part"), F.struct(F.lit("plant_part").alias("kind"), arrow(F.col("a_plant_part"), F.col("b_plant_part"), F.concat(term, F.lit(" plant part: "))).alias("change"))),
            F.when(differs("botanical_name"), F.struct(F.lit("identity").alias("kind"), arrow(_identity("a"), _identity("b"), F.concat(term, F.lit(" identity: "))).alias("change"))),
        )
    )
    return rows.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.kind", "c.change")


def version_diff(versions: DataFrame) -> DataFrame:
    """(formulation_id, version, id, kind, change): every version against the one before.

    versions: formulation_id, version, ingredients array<struct>, fields map, claims, confirmed.
    """
    order = Window.partitionBy("formulation_id").orderBy("version")
    pairs = versions.select("formulation_id", "version", "ingredients", "fields", "claims", "confirmed", *[F.lag(c).over(order).alias(f"old_{c}") for c in ("ingredients", "fields", "claims", "confirmed")]).where("old_ingredients IS NOT NULL")
    old = pairs.select("formulation_id", "version", F.explode("old_ingredients").alias("i")).select("formulation_id", "version", "i.*")
    new = pairs.select("formulation_id", "version", F.explode("ingredients").alias("i")).select("formulation_id", "version", "i.*")
    per = ingredient_diff(old, new)

    def field(name: str) -> Column:
        x, y = F.try_element_at("old_fields", F.lit(name)), F.try_element_at("fields", F.lit(name))
        return F.when(~x.eqNullSafe(y), F.struct(F.lit(name).alias("kind"), F.concat(F.lit(name.replace("_", " ") + ": "), F.coalesce(x, F.lit("—")), F.lit(" → "), F.coalesce(y, F.lit("—"))).alias("change")))

    others = F.array_compact(
        F.array(
            *map(field, HEADER),
            F.when(F.col("old_claims") != F.col("claims"), F.struct(F.lit("claims").alias("kind"), F.lit("Claims updated").alias("change"))),
            F.when(F.col("old_confirmed") != F.col("confirmed"), F.struct(F.lit("confirmed").alias("kind"), F.when(F.col("confirmed"), "Formulation confirmed").otherwise("Confirmation cleared").alias("change"))),
        )
    )
    head = pairs.select("formulation_id", "version", F.explode(others).alias("c")).select("formulation_id", "version", F.lit(None).cast("string").alias("id"), "c.kind", "c.change")
    return per.unionByName(head)


def scenario_overlay(formulations: DataFrame, ingredients: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Characteristics of a copy with other quantities, and its differences; an unknown ingredient is an error.

    overlay: formulation_id, ingredient_id, new_quantity, new_unit.
    """
    keys = ["formulation_id", "ingredient_id"]
    met = ingredients.withColumn("_known", F.lit(True)).join(overlay.withColumn("_asked", F.lit(True)), keys, "full")
    bad = F.col("_known").isNull()
    met = met.where(F.when(bad, F.raise_error(F.concat(F.lit("unknown ingredient: "), F.col("ingredient_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    copy = met.withColumns({"old_quantity": F.col("quantity"), "old_unit": F.col("unit"), "quantity": F.coalesce("new_quantity", "quantity"), "unit": F.coalesce("new_unit", "unit")})
    other = ~(F.col("old_quantity").eqNullSafe(F.col("quantity")) & F.col("old_unit").eqNullSafe(F.col("unit")))
    diffs = copy.where(other).select(*keys, F.concat("user_term", F.lit(": "), _amount(F.col("old_quantity"), F.col("old_unit")), F.lit(" → "), _amount(F.col("quantity"), F.col("unit"))).alias("change"))
    return characterize(formulations, copy), diffs
