"""Queries over search requests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import requests as rq
from ..operators.filters import SECTION3_CLAUSES
from ..queries import query
from .adapters import CHUNKS_SQL, SOURCE_TYPES, chunks, sql_list, table


def _requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plant = F.concat(F.lit("plant "), (F.col("o_custkey") % 9).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("product "), (F.col("o_custkey") % 50).cast("string")).alias("product"), F.lit(None).cast("string").alias("category"), F.array(F.lit("neem"), F.lit("tulsi")).alias("ingredients"),
        F.when(F.col("o_orderstatus") == "O", plant).alias("botanical_name"), F.when(F.col("o_orderstatus") == "O", F.array(plant, F.lit("neem"))).alias("botanical_names"),
        F.when(F.col("o_orderstatus") == "F", "international").otherwise("domestic").alias("legal_scope"), F.lit("India").alias("market"), F.lit("Kerala").alias("region"), F.lit("bio_survey").alias("purpose"),
    )


_BD = "Biological Diversity Act access biological resources approval National Biodiversity Authority State Biodiversity Board exemption"


@query("build_queries", f"""WITH r AS (SELECT o_orderkey AS case_id, 'product ' || o_custkey % 50 AS p, CASE WHEN o_orderstatus = 'O' THEN 'plant ' || o_custkey % 9 END AS b, o_orderstatus = 'F' AS far FROM orders), n AS (SELECT *, CASE WHEN b IS NULL THEN ['neem', 'tulsi'] ELSE [b, 'neem'] END AS names FROM r), q AS (SELECT case_id, list_concat([
 struct_pack(k := 'patent', q := concat_ws(' ', b, p, 'neem tulsi', CASE WHEN far THEN 'comparative international IP patentable subject matter' ELSE 'Section 3 patent traditional knowledge' END)),
 struct_pack(k := 'statute', q := concat_ws(' ', '{' '.join(['Section 3', *SECTION3_CLAUSES])}', b, p)), struct_pack(k := 'web_ip', q := coalesce(b, p) || ' neem tulsi herbal composition patent'),
 struct_pack(k := 'licence', q := 'Ayurvedic ' || p || ' neem tulsi licence regulation requirements'), struct_pack(k := 'market', q := p || ' Ayurvedic products market India'),
 struct_pack(k := 'market', q := names[1] || ' supplement brands competitors India'), struct_pack(k := 'market', q := names[2] || ' supplement brands competitors India'), struct_pack(k := 'market', q := names[1] || ' herbal products consumer demand India')],
 flatten(list_transform(names, lambda x: [struct_pack(k := 'resource', q := x || ' cultivation availability supply Kerala'), struct_pack(k := 'resource', q := x || ' conservation status wild harvest sustainability ' || CASE WHEN far THEN 'IUCN Red List CITES trade' ELSE 'Kerala NMPB' END)])),
 [struct_pack(k := 'applicability', q := concat_ws(' ', '{_BD} bio survey', CASE WHEN b IS NOT NULL THEN b || ' neem' END)), struct_pack(k := 'rate', q := 'benefit sharing percentage annual gross ex-factory sale turnover bio survey biological resources')]) AS qs FROM n)
 SELECT case_id, i - 1 AS pos, qs[i].k AS purpose_of_query, qs[i].q AS query FROM (SELECT case_id, qs, unnest(range(1, len(qs) + 1)) AS i FROM q)""")
def build_queries(spark, sf_dir):
    return rq.build_queries(_requests(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query("focused_statute_retrieval", f"WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS rank FROM lineitem), ch AS {CHUNKS_SQL}, x AS (SELECT l_orderkey AS case_id, 0 AS s, rank, 'd' || l_suppkey AS id FROM li UNION ALL SELECT l_orderkey, 1, rank, 'd' || l_partkey FROM li JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND ('d' || l_partkey) IN (SELECT id FROM ch WHERE source_type = 'statute' AND section IN {tuple(['3', *SECTION3_CLAUSES])})), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY case_id, id ORDER BY s, rank) = 1) SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY s, rank) AS pos, id FROM f")
def focused_statute_retrieval(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    li = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(" India").alias("jurisdiction"), F.when(F.col("o_orderstatus") == "O", "domestic").otherwise("international").alias("legal_scope"))
    broad = li.select(F.col("l_orderkey").alias("case_id"), "rank", F.concat(F.lit("d"), "l_suppkey").alias("id"))
    statutes = li.select(F.col("l_orderkey").alias("case_id"), "rank", F.concat(F.lit("d"), "l_partkey").alias("id"))
    return rq.focused_statute_retrieval(cases, broad, statutes, chunks(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


_TYPES = sql_list(SOURCE_TYPES)


@query("branch_retrieval", f"""WITH li AS (SELECT l_orderkey AS f, ['traditional_knowledge', 'regulatory', 'abs', 'patent'][l_linenumber % 4 + 1] AS branch, CASE WHEN l_returnflag = 'N' THEN 'domestic' ELSE 'international' END AS scope, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linenumber) AS rank, 's' || l_suppkey AS id, {_TYPES}[l_suppkey % 7 + 1] AS t FROM lineitem),
 o AS (SELECT o_orderkey AS f, CASE WHEN o_orderstatus = 'F' THEN 'international' ELSE 'domestic' END AS own, o_custkey % 5 = 0 AS blank FROM orders),
 k AS (SELECT li.f, branch, id, CAST(scope <> own AS INT) AS sr, row_number() OVER (PARTITION BY li.f, branch, scope ORDER BY rank, id) AS n FROM li JOIN o ON o.f = li.f WHERE NOT blank AND (branch = 'patent' OR scope = 'domestic') AND CASE branch WHEN 'traditional_knowledge' THEN t = 'prior_art' WHEN 'patent' THEN t IN ('patent', 'comparative_ip') ELSE t IN ('regulation', 'statute', 'guideline') END),
 m AS (SELECT * FROM k WHERE n <= 4 QUALIFY row_number() OVER (PARTITION BY f, branch, id ORDER BY sr, n) = 1), h AS (SELECT f, branch, row_number() OVER (PARTITION BY f, branch ORDER BY sr, n) AS pos, id FROM m)
 SELECT f AS formulation_id, branch, pos, id FROM h UNION ALL SELECT o.f, b.branch, NULL, NULL FROM o, (SELECT unnest(['traditional_knowledge', 'regulatory', 'abs', 'patent']) AS branch) b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.f = o.f AND h.branch = b.branch)""")
def branch_retrieval(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_partkey", "l_linenumber")
    branches, kinds = F.array(*map(F.lit, rq.BRANCHES)), F.array(*map(F.lit, SOURCE_TYPES))
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("formulation_id"), F.element_at(branches, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("branch"), F.when(F.col("l_returnflag") == "N", "domestic").otherwise("international").alias("scope"), F.row_number().over(w).alias("rank"), F.concat(F.lit("s"), "l_suppkey").alias("id"), F.element_at(kinds, (F.col("l_suppkey") % 7 + 1).cast("int")).alias("source_type"))
    forms = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("formulation_id"), F.when(F.col("o_orderstatus") == "F", "international").otherwise("domestic").alias("legal_scope"), F.when(F.col("o_custkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("neem"))).alias("terms"))
    hits, empty = rq.branch_retrieval(forms, ranked)
    return hits.withColumn("pos", F.col("pos").cast("long")).unionByName(empty.select("formulation_id", "branch", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("id")))
