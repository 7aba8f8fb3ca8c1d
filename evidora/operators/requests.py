"""Search queries of case and formulation requests, and the searches that use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import SECTION3_CLAUSES, section_label_filter
from .fusion import merge_sources

# The words and source types of each query.
BRANCHES = {
    "traditional_knowledge": (["prior_art"], True),
    "regulatory": (["regulation", "statute", "guideline"], True),
    "abs": (["statute", "guideline", "regulation"], True),
    "patent": (["patent", "comparative_ip"], False),
}
BRANCH_TOP_K = 4
STATUTE_TOP_K = 60


def _words(*parts: Column) -> Column:
    """Parts joined by spaces; null and empty ones drop out."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def resource_names(botanical_names: Column, ingredients: Column, product: Column) -> Column:
    """Plant names, else ingredients, else the product; unique in order."""
    none = F.array().cast("array<string>")

    def clean(a: Column) -> Column:
        return F.array_distinct(F.filter(F.coalesce(a, none), lambda x: x.isNotNull() & (x != "")))

    names, given = clean(botanical_names), clean(ingredients)
    return F.when(F.size(names) > 0, names).when(F.size(given) > 0, given).otherwise(clean(F.array(product)))


def build_queries(requests: DataFrame) -> DataFrame:
    """(case_id, purpose_of_query, pos, query) of requests.

    requests: case_id, product, category, ingredients, botanical_name, botanical_names,
    legal_scope, market, region, purpose.
    """
    names = resource_names(F.col("botanical_names"), F.col("ingredients"), F.col("product"))
    ing = F.array_join(F.coalesce("ingredients", F.array().cast("array<string>")), " ")
    abroad = F.lower(F.coalesce("legal_scope", F.lit("domestic"))) == "international"
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Ayurvedic"))
    use = F.replace(F.coalesce("purpose", F.lit("")), F.lit("_"), F.lit(" "))
    market, region = F.coalesce("market", F.lit("")), F.coalesce("region", F.lit(""))

    def one(purpose: str, *parts: Column) -> Column:
        return F.array(F.struct(F.lit(purpose).alias("purpose_of_query"), _words(*parts).alias("query")))

    def each(values: Column, purpose: str, *builders: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(values, lambda n: F.array(*[F.struct(F.lit(purpose).alias("purpose_of_query"), b(n).alias("query")) for b in builders])))

    tail = F.when(abroad, "comparative international IP patentable subject matter").otherwise("Section 3 patent traditional knowledge")
    care = F.when(abroad, "IUCN Red List CITES trade").otherwise(F.concat(region, F.lit(" NMPB")))
    parts = F.concat(
        one("patent", F.col("botanical_name"), F.col("product"), ing, tail),
        one("statute", F.lit(" ".join(["Section 3", *SECTION3_CLAUSES])), F.col("botanical_name"), F.col("product")),
        one("web_ip", F.coalesce("botanical_name", "product"), F.array_join(F.slice("ingredients", 1, 3), " "), F.lit("herbal composition patent")),
        one("licence", category, F.col("product"), ing, F.lit("licence regulation requirements")),
        one("market", F.col("product"), category, F.lit("products market"), market),
        each(F.slice(names, 1, 2), "market", lambda n: F.concat(n, F.lit(" supplement brands competitors "), market)),
        each(F.slice(names, 1, 1), "market", lambda n: F.concat(n, F.lit(" herbal products consumer demand "), market)),
        each(names, "resource", lambda n: F.concat(n, F.lit(" cultivation availability supply "), region), lambda n: F.concat(n, F.lit(" conservation status wild harvest sustainability "), care)),
        one("applicability", F.lit("Biological Diversity Act access biological resources approval National Biodiversity Authority State Biodiversity Board exemption"), use, F.array_join(F.coalesce("botanical_names", F.array().cast("array<string>")), " ")),
        one("rate", F.lit("benefit sharing percentage annual gross ex-factory sale turnover"), use, F.lit("biological resources")),
    )
    return requests.select("case_id", F.posexplode(parts).alias("pos", "q")).select("case_id", "q.purpose_of_query", "pos", "q.query")


def branch_queries(formulations: DataFrame) -> DataFrame:
    """(formulation_id, branch, query) of formulations (formulation_id, terms, dosage_form) with usable terms."""
    names, form = F.array_join("terms", " "), F.coalesce("dosage_form", F.lit(""))
    texts = {
        "traditional_knowledge": _words(names, F.lit("Ayurvedic pharmacopoeia formulary monograph traditional use")),
        "regulatory": _words(F.lit("Ayurvedic drug"), form, F.lit("licence manufacture sale"), names, F.lit("Drugs and Cosmetics Act")),
        "abs": _words(F.lit("biological resources access benefit sharing Biological Diversity Act"), names),
        "patent": _words(names, form, F.lit("herbal composition patent")),
    }
    rows = F.array(*[F.struct(F.lit(b).alias("branch"), t.alias("query")) for b, t in texts.items()])
    return formulations.where(F.size("terms") > 0).select("formulation_id", F.explode(rows).alias("q")).select("formulation_id", "q.*")


def focused_statute_retrieval(cases: DataFrame, broad: DataFrame, statute_hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, pos, id): broad hits, then the labelled statute hits of domestic Indian cases that are not among them.

    cases: case_id, jurisdiction, legal_scope; hits: case_id, rank, id; chunks: id, source_type, section.
    """
    wants = cases.where((F.lower(F.coalesce("legal_scope", F.lit("domestic"))) == "domestic") & (F.lower(F.trim("jurisdiction")) == "india")).select("case_id")
    labelled = chunks.where(section_label_filter(F.col("source_type"), F.col("section"))).select("id")
    extra = statute_hits.where(F.col("rank") <= STATUTE_TOP_K).join(wants, "case_id", "left_semi").join(labelled, "id", "left_semi")
    rows = broad.select("case_id", F.lit(0).alias("source_rank"), "rank", "id").unionByName(extra.select("case_id", F.lit(1).alias("source_rank"), "rank", "id"))
    return merge_sources(rows, ["case_id"], ["source_rank", "rank"]).select("case_id", "pos", "id")


def branch_retrieval(formulations: DataFrame, ranked: DataFrame, top_k: int = BRANCH_TOP_K) -> tuple[DataFrame, DataFrame]:
    """(formulation_id, branch, pos, id), and (formulation_id, branch) without hits.

    ranked: formulation_id, branch, scope, rank, id, source_type: hits of each branch query in
    each scope.  Domestic branches take domestic hits; the patent branch
    takes both, the formulation's own scope first.  Formulations without usable
    terms have all branches empty.
    """
    spec = F.create_map(*[x for b, (types, _) in BRANCHES.items() for x in (F.lit(b), F.array(*map(F.lit, types)))])
    own = formulations.select("formulation_id", F.coalesce("legal_scope", F.lit("domestic")).alias("own_scope"), "terms")
    kept = ranked.join(own.where(F.size("terms") > 0), "formulation_id").where(F.array_contains(F.element_at(spec, F.col("branch")), F.col("source_type")) & ((F.col("branch") == "patent") | (F.col("scope") == "domestic")))
    w = Window.partitionBy("formulation_id", "branch", "scope").orderBy("rank", "id")
    kept = kept.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_k).withColumn("scope_rank", (F.col("scope") != F.col("own_scope")).cast("int"))
    hits = merge_sources(kept.select("formulation_id", "branch", "scope_rank", "_k", "id"), ["formulation_id", "branch"], ["scope_rank", "_k"]).select("formulation_id", "branch", "pos", "id")
    every = own.select("formulation_id", F.explode(F.array(*map(F.lit, BRANCHES))).alias("branch"))
    return hits, every.join(hits.select("formulation_id", "branch").distinct(), ["formulation_id", "branch"], "left_anti")
