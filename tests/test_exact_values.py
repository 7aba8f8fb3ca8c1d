"""Exact values on small tables."""

import os
import random
import re
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from evidora.functions import text as T
from evidora.operators import botanical, chunking, evidence, extraction, filters, formulation, fusion, kg, lexical, pages, replay, requests, statutes
from evidora.sources import documents, store


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, "Aśvagandhā Ghṛta", T.tokenize) == ["asvagandha", "ghrta"]
    assert one(spark, "Section 3(d) and 3 (d) of the Act", T.tokenize) == ["section", "3(d)", "3", "d", "act"]
    assert one(spark, None, T.tokenize) == []
    assert one(spark, "  A \n b C ", T.normalize) == "a b c"
    assert one(spark, "IN-201 A1", T.slugify) == "in_201_a1"
    assert one(spark, "The  Patents Act, 1970", T.norm_title) == "patents act 1970"
    assert one(spark, " a  b \n\n\n\n c ", T.clean_lines) == "a b\n\nc"


def test_scope_filter(spark):
    rows = [("a", None, None), ("b", "domestic", " India "), ("c", "domestic", "epo"), ("d", "international", "epo"), ("e", "domestic", "")]
    df = spark.createDataFrame(rows, "id string, scope string, j string")

    def kept(scope, j):
        return {r.id for r in df.where(filters.scope_filter(F.col("scope"), F.col("j"), F.lit(scope).cast("string"), F.lit(j).cast("string"))).collect()}

    assert kept(None, "INDIA") == {"a", "b", "e"}
    assert kept("domestic", None) == {"a", "b", "c", "e"}
    assert kept("International", "india") == {"d"}
    with pytest.raises(Exception, match="unknown legal scope"):
        kept("galactic", None)
    early = df.where(filters.dense_prefilter(F.col("scope"), F.col("j"), F.lit("statute"), "domestic", "epo", None))
    assert {r.id for r in early.collect()} == {"c"}


def meta(df, **more):
    base = {"title": "T", "section_prefix": None, "section_label_prefix": None, "source_type": "statute", "source_url": None, "effective_date": None, "jurisdiction": "india", "legal_scope": "domestic"} | more
    for k, v in base.items():
        if k not in df.columns:
            df = df.withColumn(k, F.lit(v).cast("string"))
    return df.withColumn("is_fixture", F.lit(True))


STATUTE = """## 3. What are not inventions.
The following are not inventions:
(a) frivolous;
(d) the mere discovery, such as
(i) one;
(ii) two;
(g) [Omitted]
(h) a method;
(i) a process;
(k) a list
(i) first
(ii) second
1. Ins. by Act 15 of 2005, s. 2 (w.e.f. 1-1-2005).
wrapped note
6[(p) **traditional** knowledge.
---
CHAPTER III
APPLICATIONS
33-I. Next section body.
"""


def test_statutes(spark):
    df = meta(spark.createDataFrame([("act", STATUTE)], "doc_id string, text string"))
    got = {r.id: r for r in chunking.chunk_statutes(df).collect()}
    assert set(got) == {"act_3", "act_3_a", "act_3_d", "act_3_h", "act_3_i", "act_3_k", "act_3_p", "act_33_i"}
    assert "(ii) two" in got["act_3_d"].text and got["act_3_i"].section == "3(i)" and "(ii) second" in got["act_3_k"].text
    (_, body, notes) = statutes.normalize_statutes(df).first()
    assert notes == ["1. Ins. by Act 15 of 2005, s. 2 (w.e.f. 1-1-2005). wrapped note"] and "APPLICATIONS" not in body
    other = meta(spark.createDataFrame([("bda", "3. x\n(a) y")], "doc_id string, text string"), section_label_prefix="BDA")
    assert {r.section for r in chunking.chunk_statutes(other).collect()} == {"BDA 3", "BDA 3(a)"}
    none = meta(spark.createDataFrame([("x", "no headings")], "doc_id string, text string"))
    with pytest.raises(Exception, match="no section headings"):
        chunking.chunk_statutes(none).collect()
    (whole,) = chunking.chunk_statutes(none.withColumn("section_prefix", F.lit("7"))).collect()
    assert (whole.id, whole.section, whole.text) == ("x_7", "7", "no headings")


LAYOUT = """**3. Bold heading.—These are items of**

the Act,—

(a) alpha wraps to a

second line;

4[(b) bravo, inserted later;]

6[(d) delta.

_Explanation.—About delta_

goes on;]

1. Ins. by Act 1 of 2000, s. 2 (w.e.f. 1-1-2000).
2. Subs. by s. 3, ibid., for "old"
(w.e.f. 1-1-2000).

12

-----

(e) echo;

(f) foxtrot;

1*     -     -     -
(h) hotel;

**4. Next heading.—Words.**

2[CHAPTER IVA

RULES ON [3][SUCH] ITEMS

**33H. Third heading.—Words.**

2[33-I. Hyphen heading.—Words.

(1) a sub-section;
"""


def test_statute_layout(spark):
    after_chapter = "CHAPTER II\n1. Ins. by Act 15 of 2005\n---\nplain words\nGO ON\nmore words"
    texts = [("t", LAYOUT), ("c", after_chapter), ("p", "3. H.—head\n(d) clause d.\nExplanation.—kept.\n(e) clause e."), ("n", None), ("e", " \n\n")]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    found = {r.doc_id: r for r in statutes.normalize_statutes(df).collect()}
    assert (found["c"].body, found["c"].notes) == ("plain words\nGO ON\nmore words", ["1. Ins. by Act 15 of 2005"])
    assert (found["p"].body, found["p"].notes) == (texts[2][1], [])
    assert [(found[k].body, found[k].notes) for k in "ne"] == [("", []), ("", [])]
    assert found["t"].notes == ["1. Ins. by Act 1 of 2000, s. 2 (w.e.f. 1-1-2000).", '2. Subs. by s. 3, ibid., for "old" (w.e.f. 1-1-2000).', "[omission marker] 1*     -     -     -"]
    got = {r.id: r for r in chunking.chunk_statutes(meta(df.where("doc_id = 't'"))).collect()}
    assert {r.section for r in got.values()} == {"3", "3(a)", "3(b)", "3(d)", "3(e)", "3(f)", "3(h)", "4", "33H", "33-I"}
    assert got["t_3_b"].text == "4[(b) bravo, inserted later;]" and got["t_3_a"].text == "(a) alpha wraps to a\n\nsecond line;"
    assert got["t_3_d"].text == "6[(d) delta.\n\nExplanation.—About delta\n\ngoes on;]"
    assert got["t_4"].text == "4. Next heading.—Words." and got["t_33_i"].text.endswith("(1) a sub-section;")


def test_clause_letters(spark):
    def letters(body):
        df = meta(spark.createDataFrame([("s", "3. h\n" + body)], "doc_id string, text string"))
        return sorted(r.section for r in chunking.chunk_statutes(df).collect() if "(" in r.section)

    assert letters("(d) x\n(i) one\n(ii) two\n(e) y") == ["3(d)", "3(e)"]
    assert letters("(h) x\n(i) one\n(ii) two\n(i) again") == ["3(h)", "3(i)"]
    assert letters("(i) one\n(j) two\n(i) no\n(v) no\n(k) yes") == ["3(i)", "3(j)", "3(k)"]
    assert letters("(a)\n(b)") == ["3(a)"] and letters("(a) [Omitted]\n(c) * * *\n(d) kept") == ["3(d)"]


def sequential_groups(text, limit):
    groups, heading, current = [], None, []
    for p in [p.strip() for p in __import__("re").split(r"\n\s*\n", text) if p.strip()]:
        if "\n" not in p and len(p) <= 120 and not p.rstrip().endswith((".", ";", ":", ",")):
            if current:
                groups.append((heading, "\n\n".join(current)))
            heading, current = p, []
            continue
        if current and sum(map(len, current)) + len(p) > limit:
            groups.append((heading, "\n\n".join(current)))
            current = []
        current.append(p)
    return groups + ([(heading, "\n\n".join(current))] if current else [])


def test_guidelines_equal_a_sequential_mirror(spark):
    rnd = random.Random(1)
    texts = ["\n\n".join("x" * rnd.randint(1, 60) + rnd.choice(["", ".", "\nmore."]) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    df = meta(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), source_type="guideline")
    got = {}
    for r in chunking.chunk_guidelines(df, 100).collect():
        got.setdefault(int(r.id[1:].split("_p")[0]), {})[int(r.id.split("_p")[1])] = (r.section, r.text)
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == sequential_groups(t, 100)


def test_chunk_ids(spark):
    df = spark.createDataFrame([("a", "T", None, "x"), ("b", "T", "3(d)", "y")], "id string, title string, section string, text string")
    got = {r.id: r for r in chunking.chunk_keys(df).collect()}
    assert got["a"].point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:a"))
    assert got["b"].index_text == "T\nSection 3(d)\ny"
    with pytest.raises(Exception, match="duplicate id"):
        chunking.require_unique(df.union(df)).collect()


def test_rrf(spark):
    def fused(*lists):
        rows = [(1, i, p + 1, x) for i, ids in enumerate(lists) for p, x in enumerate(ids)]
        df = spark.createDataFrame(rows, "query_id int, list_id int, pos int, id string")
        return [(r.id, r.score) for r in fusion.rrf_fuse(df).orderBy("rank").collect()]

    assert fused("ab", "bc") == [("b", pytest.approx(1 / 62 + 1 / 61)), ("a", pytest.approx(1 / 61)), ("c", pytest.approx(1 / 62))]
    assert fused("aab", "a")[0] == ("a", pytest.approx(2 / 61)) and fused("aab", "a")[1] == ("b", pytest.approx(1 / 63))
    assert fused() == []


def test_bm25(spark):
    docs = [("a_known", "new form of a known substance without enhanced efficacy"), ("b", "plants and animals"), ("c", "computer programs per se"), ("d_trademark", "aggregation of trademark rules")]
    df = spark.createDataFrame(docs, "id string, text string")
    q = spark.createDataFrame([(1, "known substance efficacy"), (2, "aggregation trademark"), (3, "of the")], "query_id int, query string")
    got = {(r.query_id, r.rank): r.id for r in lexical.bm25_search(df, F.col("text"), q, 3).collect()}
    assert got[1, 1] == "a_known" and got[2, 1] == "d_trademark" and not any(k[0] == 3 for k in got)
    with pytest.raises(ValueError):
        lexical.require_index(df.limit(0))


def test_pages(spark):
    rows = []
    for p in range(5):
        body = ["Dose", "body line %s here" % "abcde"[p], "more", "text", "Dose"]
        lines = ["head x", *body, "Vol. %d of herbs" % p, str(p + 1)]
        rows += [("d", p, i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string")
    kept = [r.line for r in pages.strip_page_furniture(df).orderBy("page_no", "line_no").collect()]
    assert "head x" not in kept and not any(x.startswith("Vol.") for x in kept) and "1" not in kept and "text" in kept
    assert one(spark, "1 ASHWAGANDHA ROOT", pages.title_key) == "ASHWAGANDHA ROOT"
    assert one(spark, "Ashwagandha root", pages.title_key) is None
    for line, verse in [("e`fÙkdkifjfu£ers Ò;", True), ("The root is 5 mg/ml.", False), ("É", True), ("plain words here", False)]:
        assert one(spark, line, pages.is_undecodable) is verse


def reflow_mirror(lines):
    import re
    import statistics

    median = statistics.median(map(len, lines))
    paras = []
    for ln in lines:
        if paras:
            cur, prev = paras[-1], paras[-1][-1]
            terminal = bool(re.search(pages.TERMINAL, prev))
            heading = len(cur) == 1 and len(prev) < 0.6 * median and not terminal
            if not (re.match(pages.BLOCK_START, ln) or heading or (terminal and len(prev) < 0.85 * median)):
                cur.append(ln)
                continue
        paras.append([ln])
    return [" ".join(p) for p in paras]


def test_reflow_equals_a_sequential_mirror(spark):
    rnd = random.Random(2)
    docs = {f"d{k}": ["".join(rnd.choice("ab ") for _ in range(rnd.choice([3, 8, 20, 30]))).strip() + rnd.choice(["", ".", ":"]) or "x" for _ in range(rnd.randint(1, 25))] for k in range(40)}
    rows = [(d, i // 5, i % 5, x or "x") for d, ls in docs.items() for i, x in enumerate(ls)]
    got = {}
    for r in pages.reflow_prose(spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string")).orderBy("para_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {d: reflow_mirror([x or "x" for x in ls]) for d, ls in docs.items()}


def test_glyphs(spark):
    def restored(fonts, pairs):
        df = spark.createDataFrame([(w,) for w in pairs], "word string")
        assert {r.word: r.restored for r in pages.restore_glyphs(df, fonts).collect()} == pairs

    first = {"A¿vagandh¡": "Aśvagandhā", "P¤¿nipar¸¢": "Pṛśniparṇī", "Gu·£c¢": "Guḍūcī", "AáVAGANDHË": "AŚVAGANDHĀ", "CÍRÛA": "CŪRṆA", "UraÅkÀata": "Uraḥkṣata", "Paµcasak¡ra": "Pañcasakāra", "á°dhana": "Śodhana", "µg/ml": "µg/ml", "40°-60°": "40°-60°", "plain": "plain"}
    restored("A", first)
    second = {"(Bhai¾ajyaratn¢val¤,": "(Bhaiṣajyaratnāvalī,", "Rasatara¬gi´ī": "Rasataraṅgiṇī", "ABHAY¡RI½¯A": "ABHAYĀRIṢṬA", "sa¼hitā": "saṃhitā", "±amarū": "Ḍamarū", "7.0±0.2": "7.0±0.2", "Gu·£c¢": "Guḍūcī"}
    restored("AB", second)


def test_long_paragraphs(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(120))
    parts = one(spark, text, pages.pack_sentences)
    assert " ".join(parts) == text and max(map(len, parts)) <= 1500 and len(parts) == 3


def test_graph(spark):
    herbs = spark.createDataFrame([("Ocimum sanctum", ["Tulsi", "Holy basil"], 0.9, None, ["eugenol"]), ("Withania somnifera", ["Ashwagandha"], 0.6, None, [])], "botanical_name string, names array<string>, confidence double, family string, compounds array<string>")
    amb = spark.createDataFrame([("Brahmi", ["Ocimum sanctum", "Withania somnifera"])], "term string, botanicals array<string>")
    forms = spark.createDataFrame([("Mix A", ["mix"], "churna", ["Ocimum sanctum"])], "name string, aliases array<string>, dosage_form string, herbs array<string>")
    nodes, edges = kg.seed(herbs, amb, forms)
    nodes, edges = nodes.withColumn("origin", F.lit("curated")), edges.withColumn("origin", F.lit("curated"))
    terms = spark.createDataFrame([("tulsi",), (" BRAHMI",), ("Ashwagandha",), ("unknown",), ("",)], "term string")
    found = botanical.lookup(terms, nodes, edges)
    got = {r.term: r.status for r in botanical.resolve(terms, found).collect()}
    assert got == {"tulsi": "RESOLVED", " BRAHMI": "AMBIGUOUS", "Ashwagandha": "UNRESOLVED", "unknown": "UNRESOLVED", "": "UNRESOLVED"}
    batch = kg.node_rows(herbs, "Herb", F.upper("botanical_name"), F.array(F.lit("new")), {"confidence": F.lit(None)})
    merged = {r.key: r for r in kg.merge_nodes(nodes, batch, "pipeline").collect()}
    assert merged["Herb:ocimum sanctum"].name == "Ocimum sanctum" and merged["Herb:ocimum sanctum"].aliases == ["Tulsi", "Holy basil", "new"]
    assert merged["Herb:ocimum sanctum"].origin == "curated" and merged["Herb:ocimum sanctum"].props["confidence"] == "0.9"
    docs = spark.createDataFrame([(1, "Holy Basil and tulsi-like TULSI."), (2, "none")], "id int, text string")
    aliases = kg.alias_map(nodes)
    want = {(1, "Herb:ocimum sanctum", 2)}
    assert {tuple(r) for r in kg.entity_mentions(docs, aliases).collect()} == want
    text = "Mix B (churna)\n\nCategory: Powder\nMain ingredients: Tulsi (Holy basil), Guduchi, mix\nIngredients: Guduchi (Tinospora cordifolia)\nReference: r\nIndications: i\nMix C (vati)\n\nCategory: Pill\nMain ingredients: Guduchi, Salt\nIngredients: x\n"
    fdocs = spark.createDataFrame([("f", text)], "id string, text string")
    parsed = kg.parse_formulary(fdocs, kg.alias_map(nodes, ("Herb",)), kg.alias_map(nodes, ("Formulation",)))
    rows = {(r.pos, r.ingredient): r.target for r in parsed.collect()}
    assert rows == {(0, "Tulsi"): "Herb:ocimum sanctum", (0, "Holy basil"): "Herb:ocimum sanctum", (0, "Guduchi"): "Herb:tinospora cordifolia", (0, "mix"): "Formulation:mix a", (1, "Guduchi"): "Herb:tinospora cordifolia", (1, "Salt"): "Ingredient:salt"}


def test_graph_merge_keeps_the_order_of_a_batch(spark):
    empty = kg.node_rows(spark.createDataFrame([], "n string"), "Herb", F.col("n")).withColumn("origin", F.lit("corpus"))
    batch = spark.createDataFrame([("Tulsi", "1", ["a"]), ("TULSI", "2", ["b", "a"]), ("tulsi", None, ["c"])], "n string, v string, a array<string>").coalesce(1)
    (row,) = kg.merge_nodes(empty, kg.node_rows(batch, "Herb", F.col("n"), F.col("a"), {"v": F.col("v")}), "pipeline").collect()
    assert (row["name"], row.aliases, row.props) == ("Tulsi", ["a", "b", "c"], {"v": "2"})


def test_graph_neighborhood_and_search(spark):
    names = spark.createDataFrame([(c,) for c in "abcdef"], "n string")
    nodes = kg.node_rows(names, "Herb", F.col("n"), F.array(F.concat(F.lit("Alias of "), "n")))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "s string, t string")
    edges = kg.edge_rows(pairs, kg.node_key(F.lit("Herb"), F.col("s")), kg.node_key(F.lit("Herb"), F.col("t")), "CONTAINS")
    reached, taken, truncated = kg.neighborhood(spark.createDataFrame([("Herb:a",)], "center string"), nodes, edges, depth=2, limit=10)
    assert {(r.key, r.hop) for r in reached.collect()} == {("Herb:a", 0), ("Herb:b", 1), ("Herb:c", 1), ("Herb:d", 2)} and not truncated.first().truncated
    assert {(r.source[5:], r.target[5:]) for r in taken.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "a")}
    reached, taken, truncated = kg.neighborhood(spark.createDataFrame([("Herb:a",)], "center string"), nodes, edges, depth=1, limit=2)
    assert {r.key for r in reached.collect()} == {"Herb:a", "Herb:b"} and truncated.first().truncated
    asked = spark.createDataFrame([("AS OF c",), ("a",), ("zz",), (" ",)], "query string")
    found = {(r.query, r["rank"], r.key) for r in kg.search(asked, nodes, limit=2).collect()}
    assert found == {("AS OF c", 1, "Herb:c"), ("a", 1, "Herb:a"), ("a", 2, "Herb:b")}


def test_graph_of_responses_patents_and_formularies(spark):
    cases = spark.createDataFrame([(1, "Balm"), (2, "Tea")], "case_id int, product string")
    plants = spark.createDataFrame([(1, "RESOLVED", "Tulsi", "Ocimum sanctum", ["Holy basil"], [], ["eugenol"]), (2, "AMBIGUOUS", "Brahmi", None, [], [("Bacopa monnieri", 0.5)], [])], "case_id int, status string, input_term string, botanical_name string, synonyms array<string>, candidates array<struct<botanical_name:string,confidence:double>>, phytochemicals array<string>")
    texts = spark.createDataFrame([(1, "s1", "On holy basil", "Brahmi and tulsi and ghee"), (2, "s2", None, "Brahmi, brahmi; tulsi")], "case_id int, id string, title string, text string")
    rivals = spark.createDataFrame([(1, "Rub")], "case_id int, name string")
    vocabulary = spark.createDataFrame([("ghee", "Ingredient:ghee")], "term string, key string")
    nodes, edges = kg.from_responses(cases, plants, texts, rivals, vocabulary)
    got = {(r.source, r.target, r.type): r.props for r in edges.collect()}
    mentions = {(s, t): p["count"] for (s, t, k), p in got.items() if k == "MENTIONED_IN"}
    assert mentions == {("Herb:ocimum sanctum", "Source:s1"): "2", ("Ingredient:ghee", "Source:s1"): "1", ("Name:brahmi", "Source:s2"): "2"}
    assert ("Product:rub", "Product:balm", "COMPETES_WITH") in got and got["Herb:ocimum sanctum", "Product:balm", "INGREDIENT_OF"] == {"input_term": "Tulsi"}
    assert {r.key for r in nodes.collect()} == {"Product:balm", "Product:tea", "Product:rub", "Herb:ocimum sanctum", "Name:brahmi", "Herb:bacopa monnieri", "Compound:eugenol", "Source:s1", "Source:s2", "Ingredient:ghee"}
    patents = spark.createDataFrame([(0, "P1", " Tulsi balm ", "x" * 700, None, "2020", None, "in"), (1, "P2", "", "a tulsi use", None, None, "u", None), (2, "P3", "none", "", None, None, None, None)], "pos int, publication_number string, title string, abstract string, first_claim string, publication_date string, url string, jurisdiction string")
    nodes, edges = kg.patent_graph(patents, spark.createDataFrame([("tulsi", "Herb:t")], "term string, key string"))
    assert {r.key: (r["name"], r.props.get("url"), len(r.props["snippet"])) for r in nodes.collect()} == {"Patent:p1": ("Tulsi balm", None, 600), "Patent:p2": ("P2", "u", 11)}
    assert {(r.source, r.target, r.props["in_title"]) for r in edges.collect()} == {("Herb:t", "Patent:p1", "true"), ("Herb:t", "Patent:p2", "false")}
    text = "Mix (churna)\n\nCategory: Powder\nMain ingredients: Tulsi, Guduchi, Salt\nIngredients: Guduchi (Tinospora cordifolia)\nReference: r\nIndications: i\nNew (vati)\n\nCategory: Pill\nMain ingredients: Guduchi, mix\nIngredients: x\n"
    herbs, forms = (spark.createDataFrame([x], "term string, key string") for x in (("tulsi", "Herb:t"), ("mix", "Formulation:known mix")))
    nodes, edges = kg.formulary_graph(spark.createDataFrame([("f", "Book", text)], "id string, title string, text string"), herbs, forms)
    held = {r.key: r for r in nodes.collect()}
    assert set(held) == {"Formulation:known mix", "Formulation:new", "Category:powder", "Category:pill", "Herb:tinospora cordifolia", "Ingredient:salt"}
    assert held["Formulation:known mix"].aliases == ["Mix"] and held["Formulation:known mix"].props == {"dosage_form": "churna", "reference": "r", "indications": "i", "source_document": "Book"}
    assert held["Herb:tinospora cordifolia"].aliases == ["Guduchi"] and held["Herb:tinospora cordifolia"].props == {"confidence": "0.85"}
    assert {(r.source, r.target) for r in edges.collect()} == {
        ("Herb:t", "Formulation:known mix"), ("Herb:tinospora cordifolia", "Formulation:known mix"), ("Ingredient:salt", "Formulation:known mix"), ("Formulation:known mix", "Category:powder"),
        ("Herb:tinospora cordifolia", "Formulation:new"), ("Formulation:known mix", "Formulation:new"), ("Formulation:new", "Category:pill"),
    }


def test_mentions_equal_the_pattern_for_any_dictionary(spark):
    terms = ["holy basil", "holy", "basil leaf", "st. john's wort", "a/b, c", "(l.)", "oil of the dried leaf and root of tulsi", "tulsi", "x-ray", "ghṛta", "wort (dry)"]
    texts = [
        "Holy basil leaf, St. John's Wort (dry) and a/b, c; ba/b, c; Ocimum (L.) x(l.) (l.)y.", "OIL of the dried leaf and root of tulsi. tulsi-like x-ray xx-ray",
        "holy Basil leaf holy basil\nleaf", "GHṚTA ghṛtam tulsi", "", None, "tulsi tulsi,tulsi (l.)(l.)",
    ]
    pattern = re.compile(r"(?<![\w-])(?:" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")(?![\w-])", re.IGNORECASE)
    want = {}
    for i, t in [*enumerate(texts), (0, texts[0])]:  # a repeated row counts again
        for m in pattern.finditer(t or ""):
            want[(i, f"K:{m[0].lower()}")] = want.get((i, f"K:{m[0].lower()}"), 0) + 1
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "id int, text string").repartition(3)
    few = spark.createDataFrame([(t, f"K:{t}") for t in terms], "term string, key string")
    many = few.union(spark.range(5001).select(F.concat(F.lit("term"), "id"), F.lit("other")))
    for aliases in (few, many):
        assert {(r.id, r.key): r.n for r in kg.entity_mentions(docs, aliases).collect()} == want
    assert kg.entity_mentions(docs, few.limit(0)).count() == 0


def test_evidence(spark):
    assert [one(spark, x, evidence.clause_ref) for x in ("Section 3(K)", "3 (k)", " other ")] == ["3(k)", "3(k)", "other"]
    assert one(spark, "0.1 per cent, 0.2 percent or 0.5%", evidence.percentages_in_text) == [0.1, 0.2, 0.5]
    fees = spark.createDataFrame([(2e7, 0.2), (333.33, 0.5)], "t double, p double").select(evidence.abs_fee(F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in fees] == [40000.0, 1.67]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(-1.0, 0.5)], "t double, p double").select(evidence.abs_fee(F.col("t"), F.col("p"))).collect()
    prov = spark.createDataFrame([(1, 0, "3(d)", True, "r", ["s1", "zz"]), (1, 1, "3(e)", True, "r", ["s1"]), (1, 2, "3(p)", False, "r", ["s2"]), (1, 3, "3(d)", True, "r", ["s2"])], "case_id int, pos int, clause string, triggered boolean, reason string, evidence_source_ids array<string>")
    src = spark.createDataFrame([(1, "s1", "Section 3(D)"), (1, "s2", None)], "case_id int, id string, section string")
    out = {r.pos: r for r in evidence.sanitize_section3(prov, src).collect()}
    assert out[0].evidence_source_ids == ["s1"] and not out[1].triggered and out[1].evidence_gap and out[1].reason.startswith("r [trigger cleared")
    risk = evidence.section3_risk(evidence.sanitize_section3(prov, src)).first()
    assert risk.risk == 0.35 and risk.triggered == ["3(d)"]
    drafts = spark.createDataFrame([("Keep. Drop this.\n\n\nEnd.", ["Drop this."])], "d string, s array<string>")
    assert drafts.select(evidence.strip_claims(F.col("d"), F.col("s"))).first()[0] == "Keep. \n\nEnd.\n\n[Unsupported claims were removed pending human review.]"


@pytest.mark.parametrize("statuses,reasons,outcome", [(["SUPPORTED"], [], "PASS"), (["UNSUPPORTED", "UNSUPPORTED", "SUPPORTED"], [], "FAIL"), (["UNSUPPORTED", "SUPPORTED", "PARTIALLY_SUPPORTED"], [], "HUMAN_REVIEW_REQUIRED"), (["SUPPORTED"], ["ambiguous_botanical"], "HUMAN_REVIEW_REQUIRED"), ([], [], "PASS")])
def test_rollup(spark, statuses, reasons, outcome):
    cases = spark.createDataFrame([(1, reasons, [])], "case_id int, reasons array<string>, stripped array<string>")
    v = spark.createDataFrame([(1, i, f"c{i}", s) for i, s in enumerate(statuses)], "case_id int, pos int, claim string, status string")
    src = spark.createDataFrame([(1, "s")], "case_id int, id string")
    assert evidence.verify_rollup(cases, v, src).first().outcome == outcome
    assert evidence.verify_rollup(cases, v, src.limit(0)).first().outcome == "HUMAN_REVIEW_REQUIRED"


REPLAY = "formulation_id long, seq long, base_version int, type string, ingredient_id string, user_term string, quantity double, unit string, plant_part string, botanical_name string, field string, value string, claims array<string>, synonyms array<string>, candidates array<struct<botanical_name:string,synonyms:array<string>>>"
REPLAY_FIELDS = [f.split()[0] for f in REPLAY.split(", ")][1:]


def actions_of(spark, log, key=1):
    return spark.createDataFrame([(key, *[({"seq": i} | a).get(f) for f in REPLAY_FIELDS]) for i, a in enumerate(log, 1)], REPLAY)


def test_replay_and_diff(spark):
    log = [
        {"type": "CONFIRM_FORMULATION"}, {"type": "ADD_INGREDIENT", "user_term": "Tulsi", "ingredient_id": "t", "quantity": 5.0, "unit": "mg", "botanical_name": "Ocimum"}, {"type": "ADD_INGREDIENT", "user_term": " tulsi "},
        {"type": "ADD_INGREDIENT", "user_term": "Basil", "botanical_name": "Ocimum"}, {"type": "UPDATE_INGREDIENT", "ingredient_id": "t"}, {"type": "UPDATE_INGREDIENT", "ingredient_id": "t", "quantity": 7.5}, {"type": "UPDATE_FIELD", "field": "purpose", "value": "nonsense"},
        {"type": "UPDATE_FIELD", "field": "purpose", "value": "IPR", "base_version": 3}, {"type": "UPDATE_FIELD", "field": "name", "value": "x", "base_version": 1}, {"type": "CONFIRM_FORMULATION"}, {"type": "REMOVE_INGREDIENT", "ingredient_id": "t"},
    ]
    out = replay.replay_actions(actions_of(spark, log))
    got = [(r.status, r.summary) for r in out.orderBy("seq").collect()]
    assert [s for s, _ in got] == ["rejected", "applied", "rejected", "rejected", "rejected", "applied", "rejected", "applied", "conflict", "applied", "applied"]
    assert got[6][1] == "Invalid purpose: 'nonsense'. Allowed: commercial_utilization, research, bio_survey, ipr." and got[8][1] == "Based on version 1, current is 4."
    changes = [r.change for r in formulation.version_diff(replay.versions(out)).orderBy("version", "kind").collect()]
    assert changes == ["Tulsi: 5 mg → 7.5 mg", "purpose: — → ipr", "Formulation confirmed", "Removed Tulsi"]


def test_replay_looks_at_all_names(spark):
    """Terms are compared with ids, terms, identities and synonyms as they are; identities are chosen among candidates."""
    two = [("Tinospora cordifolia", ["guduchi"]), ("Tinospora sinensis", [])]
    log = [
        ({"type": "ADD_INGREDIENT", "user_term": "Giloy", "ingredient_id": "g", "candidates": two}, "applied", "Added Giloy (no quantity)"),
        ({"type": "ADD_INGREDIENT", "user_term": "tinospora cordifolia"}, "applied", "Added tinospora cordifolia (no quantity)"),  # not resolved yet
        ({"type": "REMOVE_INGREDIENT", "ingredient_id": "ing_2"}, "applied", "Removed tinospora cordifolia"),
        ({"type": "RESOLVE_ENTITY", "ingredient_id": "g", "botanical_name": "Ocimum"}, "rejected", "'Ocimum' is not one of the candidates for 'Giloy'."),
        ({"type": "RESOLVE_ENTITY", "ingredient_id": "g"}, "rejected", "'' is not one of the candidates for 'Giloy'."),
        ({"type": "RESOLVE_ENTITY", "ingredient_id": "g", "botanical_name": " tinospora CORDIFOLIA"}, "applied", "Resolved Giloy as Tinospora cordifolia"),
        ({"type": "ADD_INGREDIENT", "user_term": "tinospora cordifolia"}, "rejected", "tinospora cordifolia is already in the formulation."),
        ({"type": "ADD_INGREDIENT", "user_term": "Guduchi "}, "rejected", "Guduchi is already in the formulation."),
        ({"type": "ADD_INGREDIENT", "user_term": "G"}, "rejected", "G is already in the formulation."),
        ({"type": "ADD_INGREDIENT", "user_term": "tinospora  cordifolia"}, "applied", "Added tinospora  cordifolia (no quantity)"),  # inner white space counts
        ({"type": "ADD_INGREDIENT", "user_term": "Amrita", "botanical_name": "Tinospora cordifolia"}, "rejected", "Amrita resolves to Tinospora cordifolia, which is already in the formulation."),
        ({"type": "UPDATE_INGREDIENT", "ingredient_id": "g", "quantity": 2.0, "unit": "g", "user_term": "Neem", "botanical_name": "Azadirachta"}, "applied", "Neem: no quantity → 2 g"),
        ({"type": "ADD_INGREDIENT", "user_term": "azadirachta"}, "rejected", "azadirachta is already in the formulation."),
        ({"type": "ADD_INGREDIENT", "user_term": "giloy"}, "applied", "Added giloy (no quantity)"),
        ({"type": "UPDATE_CLAIMS", "claims": [" a ", "", "b"]}, "applied", "Claims updated (2)"),
        ({"type": "UPDATE_FIELD", "field": "jurisdiction", "value": " "}, "applied", "Jurisdiction: india → india"),
        ({"type": None}, "rejected", "Unsupported action None."),
    ]
    got = replay.replay_actions(actions_of(spark, [a for a, _, _ in log])).orderBy("seq").collect()
    assert [(r.status, r.summary) for r in got] == [x[1:] for x in log]


@pytest.mark.parametrize("buffer", [10_000, 3])
def test_batch_and_stream_agree(spark, tmp_path, monkeypatch, buffer):
    """Over a log that comes in four micro-batches, in any order."""
    from evidora.plans.formulations import _actions
    from evidora.streaming import jobs

    monkeypatch.setattr(replay, "BUFFER", buffer)
    events = spark.range(90).selectExpr("id AS event_id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 4 END AS user_id", "timestamp_seconds(id) AS ts", "'e' AS event_type", "id * 1.5D AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    actions = _actions(spark, str(tmp_path)).cache()
    for part in (2, 0, 3, 1):
        actions.where(f"(seq * 7 + formulation_id) % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.replay_job(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = replay.replay_actions(actions).collect()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch))
    assert {r.status for r in batch} == {"applied", "rejected", "conflict"}


def test_written_numbers(spark):
    said = "ashwagandha 10000000 mg, tulsi 0.0001 mg, neem 0.5 g, amla 1e-05 g, haldi 1e+07 mg, ginger 1234567.5 mg, clove 7.0 g, mint 12 g"
    texts = spark.createDataFrame([(1, said)], "id int, text string")
    values = [("ashwagandha", 1e7, True), ("tulsi", 1e-4, True), ("neem", 0.5, True), ("amla", 1e-5, True), ("haldi", 1e7, True), ("ginger", 1234567.5, True), ("clove", 7.0, True), ("mint", 2.0, False), ("said", 0.05, False)]
    df = spark.createDataFrame([(1, i, t, q, "mg", None) for i, (t, q, _) in enumerate(values)], "id int, pos int, user_term string, quantity double, unit string, plant_part string")
    got = {r.user_term: r.quantity for r in extraction.ground_extraction(df, texts).collect()}
    assert {t: got[t] == q for t, q, _ in values if t != "said"} == {t: ok for t, _, ok in values if t != "said"}


def test_extraction(spark):
    texts = spark.createDataFrame([(1, "500 mg of Tulsi leaf, neem (20 g), resin of tulsi; x-tulsi, 300 mg shilajit and 2 g daily"), (2, "Holy Tulsi 5 mg with tulsi leaves"), (3, None)], "id int, text string")
    got = [tuple(r)[:6] for r in extraction.extract_ingredients(texts, ["Tulsi", "Neem", "holy tulsi"]).orderBy("id", "pos").collect()]
    assert got == [(1, 1, "Tulsi", 500.0, "mg", "leaf"), (1, 2, "tulsi", None, None, "resin"), (1, 3, "neem", 20.0, "g", "leaf"), (1, 4, "shilajit", 300.0, "mg", None), (2, 1, "Holy Tulsi", 5.0, "mg", None), (2, 2, "tulsi", None, None, "leaf")]
    rng = random.Random(5)
    bits = ["tulsi", "Holy Tulsi", "neem", "tulsi-neem", "5 mg of", "20g", "300 mg shilajit", "2 ml amla", "leaf", "root of", ",", "(", ")", "é", "\n", "7 mg daily"]
    many = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(200)]
    rows = extraction.extract_ingredients(spark.createDataFrame(many, "id int, text string"), ["tulsi", "neem", "holy tulsi"]).collect()
    for i, text in many:
        alone = re.findall(r"(?<![\w-])(?:holy tulsi|tulsi|neem)(?![\w-])", text, re.I)
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.pos)
        named = [r.user_term for r in own if r.user_term.lower() in ("tulsi", "neem", "holy tulsi")]
        assert sorted(named) == sorted(alone) and [r.pos for r in own] == list(range(1, len(own) + 1))
        counted = [r for r in own if r.user_term not in named]
        assert all(re.fullmatch(r"\d+ ?(mg|ml|g)\s+(of\s+)?" + r.user_term, r.source_text) and r.quantity and r.unit for r in counted)
        assert len([r for r in counted if r.user_term in ("shilajit", "amla")]) == text.count("shilajit") + text.count("amla")
        firsts = [text.lower().find(r.user_term.lower()) for r in own]
        assert firsts == sorted(firsts)
    said = "A syrup named 'Calm Mix' for oral use in cough, then check; capsules for my shop"
    assert tuple(extraction.extract_header(spark.createDataFrame([(1, said)], "id int, text string")).first()) == (1, "Calm Mix", "capsule", "oral", "oral use in cough")
    items = [(1, 1, "Tulsi leaf", 500.0, "MG", None), (1, 2, "tulsi", None, None, None), (1, 3, "root of Neemx", 7.0, "g", None), (1, 4, "Shilajitum", 30.0, "mg", "resin"), (1, 5, "", None, None, None)]
    df = spark.createDataFrame(items, "id int, pos int, user_term string, quantity double, unit string, plant_part string")
    rows = [tuple(r)[2:] for r in extraction.ground_extraction(df, texts).orderBy("pos").collect()]
    assert rows[0] == ("Tulsi", 500.0, "mg", "leaf", True, []) and rows[1][4:] == (False, [])
    assert rows[2][0] == "Neemx" and rows[2][4:] == (False, ["ingredient:Neemx"])
    assert rows[3] == ("Shilajitum", None, None, "resin", True, ["quantity:Shilajitum"]) and rows[4][4:] == (False, ["ingredient:"])
    claims = spark.createDataFrame([(1, 1, "Tulsi leaf gives strength today"), (1, 2, "cures most known diseases of humans"), (1, 3, "a b")], "id int, pos int, claim string")
    assert [r.kept for r in extraction.ground_claims(claims, texts).orderBy("pos").collect()] == [True, False, False]
    head = spark.createDataFrame([(1, "tulsi drops", "nasal", "", "Neem Mix")], "id int, dosage_form string, route string, target_market string, name string")
    assert tuple(extraction.ground_header(head, texts).first())[1:] == ("tulsi drops", "", "", "Neem Mix", ["route:nasal"])


def test_intents(spark):
    def tags(text, ingredients=False, form="", use="", continued=None):
        return one(spark, text, lambda c: extraction.tag_intents(c, F.lit(ingredients), F.lit(form), F.lit(use), None if continued is None else F.lit(continued)))

    assert tags("/ABS please").intents == ["CHECK_ABS"] and tags("/map").decoder == "command"
    assert tags("hello").intents == ["GENERAL_QUESTION"] and tags(None).intents == ["GENERAL_QUESTION"]
    assert tags("add tulsi", True).intents == ["CREATE_FORMULATION"] and tags("add tulsi", True, continued=True).intents == ["ADD_INGREDIENT"]
    assert tags("set tulsi to 5", True).intents == ["UPDATE_QUANTITY"] and tags("drop tulsi", True).intents == ["REMOVE_INGREDIENT"]
    assert tags("what if we drop tulsi and compare", True).intents == ["SCENARIO", "COMPARE_FORMULATIONS"]
    assert tags("resolve it").intents == ["GENERAL_QUESTION"] and tags("resolve it", True).intents == ["CREATE_FORMULATION", "RESOLVE_AMBIGUITY"]
    path = tags("Why is ABS relevant to the patent?")
    assert path.intents == ["SHOW_DECISION_PATH", "VIEW_EVIDENCE"] and path.graph_filter == "abs"
    view = tags("show patent-related information")
    assert view.intents == ["SHOW_DECISION_PATH"] and view.graph_filter == "patent"
    assert tags("check the patent sources").intents == ["ANALYZE_PATENT", "VIEW_EVIDENCE"] and tags("patent sources").intents == ["VIEW_EVIDENCE"]
    facts = tags("commercial research by a foreign firm with wild plants")
    assert (facts.purpose, facts.entity_type, facts.resource_source) == ("commercial_utilization", "foreign", "wild")


def test_claims_and_evidence(spark):
    forms = spark.createDataFrame([(1,), (2,)], "formulation_id int")
    ing = spark.createDataFrame([(1, 1, "a", "confirmed", "Ocimum"), (1, 2, "b", "probable", "Ocimum"), (1, 3, "c", "ambiguous", None), (1, 4, "d", "confirmed", None)], "formulation_id int, pos int, ingredient_id string, identity_status string, botanical_name string")
    hits = spark.createDataFrame([(1, "abs", 2, "s2"), (1, "abs", 1, "s1"), (1, "patent", 1, "s3")], "formulation_id int, branch string, rank int, id string")
    claims = formulation.formulation_claims(forms, ing, hits)
    got = {(r.formulation_id, r.claim): (r.branch, r.subject_ids, r.candidate_ids) for r in claims.collect()}
    assert got == {
        (1, formulation.LICENCE_CLAIM): ("regulatory", ["regulatory"], []), (2, formulation.LICENCE_CLAIM): ("regulatory", ["regulatory"], []),
        (1, formulation.RESOURCE_CLAIM): ("abs", ["bio:a", "bio:b"], ["s1", "s2"]), (1, formulation.ACCESS_CLAIM): ("abs", ["abs"], ["s1", "s2"]),
        (1, "Ocimum is described in Ayurvedic pharmacopoeial or classical formulary texts."): ("traditional_knowledge", ["traditional_knowledge"], []),
        (1, "Patent documents disclose compositions containing Ocimum."): ("patent", ["prior_art"], ["s3"]),
    }
    said = [(1, formulation.RESOURCE_CLAIM.upper() + ".", "SUPPORTED", ["s1", "x"]), (1, formulation.ACCESS_CLAIM, "PARTIALLY_SUPPORTED", ["s1"]), (1, "Patent documents disclose compositions containing Ocimum", "SUPPORTED", ["s1"]), (1, formulation.LICENCE_CLAIM, "SUPPORTED", [])]
    verdicts = spark.createDataFrame(said, "formulation_id int, claim string, status string, evidence_source_ids array<string>")
    subjects, sources, edges = formulation.claim_evidence(claims, verdicts)
    assert {(r.formulation_id, r.subject_id): r.status for r in subjects.collect()} == {
        (1, "bio:a"): "confirmed", (1, "bio:b"): "confirmed", (1, "abs"): "probable", (1, "prior_art"): "insufficient_evidence", (1, "traditional_knowledge"): "insufficient_evidence", (1, "regulatory"): "insufficient_evidence", (2, "regulatory"): "insufficient_evidence",
    }
    assert {r.source_id: r.status for r in sources.collect()} == {"s1": "SUPPORTED", "s2": "UNSUPPORTED", "s3": "UNSUPPORTED"}
    assert sorted(r.subject_id for r in edges.collect()) == ["abs", "bio:a", "bio:b"]
    gone = spark.createDataFrame([(1, formulation.RESOURCE_CLAIM)], "formulation_id int, claim string")
    assert {r.source_id: r.status for r in formulation.claim_evidence(claims, verdicts, gone)[1].collect()}["s1"] == "PARTIALLY_SUPPORTED"


def test_review_reasons(spark):
    sources = spark.createDataFrame([(i, "s") for i in range(5)], "case_id int, id string")
    cases = spark.createDataFrame([(0, ["section3_evidence_gap"]), (1, ["missing_evidence"]), (2, ["missing_evidence"]), (3, ["web_search_failed"]), (9, [])], "case_id int, reasons array<string>").withColumn("stripped", F.array().cast("array<string>"))
    verdicts = spark.createDataFrame([(0, 1, "a", "SUPPORTED"), (1, 1, "a", "UNSUPPORTED"), (2, 1, "a", "SUPPORTED"), (3, 1, "a", "SUPPORTED"), (9, 1, "a", "SUPPORTED")], "case_id int, pos int, claim string, status string")
    got = {r.case_id: (r.outcome, r.reasons) for r in evidence.verify_rollup(cases, verdicts, sources, ["web_search_failed"]).collect()}
    assert got == {0: ("HUMAN_REVIEW_REQUIRED", ["section3_evidence_gap"]), 1: ("FAIL", ["missing_evidence", "unsupported_claims"]), 2: ("PASS", ["missing_evidence"]), 3: ("HUMAN_REVIEW_REQUIRED", ["web_search_failed"]), 9: ("HUMAN_REVIEW_REQUIRED", ["missing_evidence"])}


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_text("hello")
    (tmp_path / "sub/a.meta.json").write_text('{"doc_id": "a", "title": "A", "source_type": "statute", "jurisdiction": "India", "legal_scope": "domestic"}')
    (tmp_path / "b.md").write_text("no sidecar")
    (tmp_path / "sub/d.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub/d.meta.json").write_text('{"doc_id": "d"}')
    (tmp_path / "sub/E.HTM").write_text("<p>x <nav>no</nav></p>y<p>z\u00a0 w</p>")
    (tmp_path / "sub/E.meta.json").write_text('{"doc_id": "e"}')
    (tmp_path / "sub/f.txt").write_bytes(b" bad \xff byte\t\tend \r\n\n\n\nx")
    (tmp_path / "sub/f.meta.json").write_text('{"doc_id": "f"}')
    (tmp_path / ".h.txt").write_text("hidden")
    (tmp_path / "odd.csv").write_text("other")
    (tmp_path / "sub/c.html").write_text(" ")
    (tmp_path / "sub/c.meta.json").write_text('{"doc_id": "c"}')
    docs, skipped = documents.load_documents(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text, r.suffix) for r in docs.collect()) == [("a", "hello", "txt"), ("e", "x\n\nz w", "htm"), ("f", "bad \ufffd byte end\n\nx", "txt")]
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in skipped.collect()) == [("b.md", "no sidecar"), ("c.html", "no text"), ("d.pdf", "pdf")]
    (tmp_path / "wrong").mkdir()
    (tmp_path / "wrong/r.json").write_text("[]")
    (tmp_path / "wrong/r.meta.json").write_text('{"doc_id": "r", "source_type": "statute"}')
    with pytest.raises(Exception, match="record files need source_type patent"):
        documents.load_documents(spark, str(tmp_path / "wrong"))[0].collect()
    at = str(tmp_path / "made")
    assert documents.write_documents(spark.createDataFrame([("x/a.txt", "one"), ("x/a.meta.json", "{}")], "path string, content string"), f"file://{at}") == 2
    assert [r.text for r in documents.load_documents(spark, at)[0].collect()] == ["one"]
    good, bad = documents.validate_metadata(docs.where("doc_id = 'a'").select("doc_id", "section_label_prefix", "jurisdiction", "source_type", "legal_scope"))
    assert good.first().jurisdiction == "india" and bad.count() == 0
    assert documents.html_text("<html><script>x</script><h1>Title</h1><nav><p>no</p></nav><p>One <b>two</b></p><li>three</li></html>") == "Title\n\nOne two\n\nthree"
    assert documents.html_text("just text") == "just text"
    with pytest.raises(Exception, match="anchor not found"):
        documents.excerpt_by_anchor(spark.createDataFrame([("a", "x\ny")], "doc_id string, text string"), spark.createDataFrame([(1, "a", None, "nowhere", None)], "spec_id int, doc_id string, after string, start string, end string")).collect()


def test_write_index(spark, tmp_path):
    at, schema = str(tmp_path / "index"), "id string, text string, legal_scope string, source_type string, seq long"
    rows = spark.createDataFrame([(f"a{i}", "old", "domestic", "statute", 1) for i in range(300)], schema)
    store.write_index(rows, at)
    files = lambda: {p.relative_to(at) for p in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    changes = spark.createDataFrame([("a7", "new", "international", "patent", 5), ("a7", "older", "domestic", "patent", 4), ("b", "more", "domestic", "patent", 5)], schema)
    assert store.write_index(changes, at, batch="one") == at
    want = {f"a{i}": "old" for i in range(300)} | {"a7": "new", "b": "more"}
    held = lambda: sorted((r.id, r.text) for r in store.read_parts(spark, at).collect())
    assert held() == sorted(want.items())
    # Only the parts of the two ids have other files.
    parts = {r.p for r in changes.selectExpr(f"pmod(xxhash64(id), {store.PARTS}) AS p").collect()}
    assert {p.parts[0] for p in before ^ files()} == {f"part_of_{store.PARTS}={p}" for p in parts}
    # The same batch again, and after a loss of a part that was about to be replaced.
    store.write_index(changes, at, batch="one")
    assert held() == sorted(want.items())
    shutil.rmtree(tmp_path / "index" / f"part_of_{store.PARTS}={sorted(parts)[0]}")
    store.write_index(changes, at, batch="one")
    assert held() == sorted(want.items())
    store.write_index(changes.where("id = 'b'"), at, batch="two")
    assert held() == sorted(want.items())
    store.write_index(changes.where("id = 'b'"), at, recreate=True)
    assert held() == [("b", "more")]
    with pytest.raises(ValueError):
        store.write_index(rows.limit(0), at)


def test_clear_deletes_what_was_written(spark):
    df = spark.range(5)
    assert store.written(df, "x").count() == 5 and store.written_in_buckets(df, "y", "id").count() == 5
    made = list(store._MADE)
    assert len(made) >= 2 and all(store.exists(spark, p) for p in made)
    assert store.clear(spark) == len(made) and not any(store.exists(spark, p) for p in made) and store.clear(spark) == 0


def test_domains(spark):
    hits = spark.createDataFrame([("https://www.WHO.int/x",), ("http://who.int",), ("https://nowho.int",), (None,)], "url string")
    allowed = spark.createDataFrame([("who.int",)], "domain string")
    assert {r.url for r in filters.domain_allowlist(hits, allowed).collect()} == {"https://www.WHO.int/x", "http://who.int"}


def test_branches(spark):
    forms = spark.createDataFrame([(1, ["neem"], "churna"), (2, [], None)], "formulation_id int, terms array<string>, dosage_form string")
    got = requests.branch_queries(forms).collect()
    assert len(got) == 4 and {r.formulation_id for r in got} == {1}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_chunk_corpus_takes_every_document_once(spark):
    from evidora.plans import adapters, retrieval

    sf = "/root/testdata/sf0.001"

    def groups(text):
        out, heading, current, size = [], None, [], 0
        for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
            if p and "\n" not in p and len(p) <= 120 and not re.search(r"[.;:,]\s*$", p):
                out, heading, current, size = out + ([(heading, current)] if current else []), p, [], 0
            elif p:
                if current and size + len(p) > 1500:
                    out, current, size = [*out, (heading, current)], [], 0
                current, size = [*current, p], size + len(p)
        return [(h, "\n\n".join(c)) for h, c in (out + ([(heading, current)] if current else []))]

    want = []
    for d in adapters.chunks(spark, sf).collect():
        lines = d.text.split("\n")
        if d.source_type == "statute":
            continue
        elif d.source_type == "patent":
            stem = f"patent_us_{d.doc_id}_a1"
            want.append((f"{stem}_abstract", "abstract", len("\n".join(lines[1:]).strip())))
            if d.doc_id % 3 == 0 and len(lines) > 1 and lines[1].strip():
                want.append((f"{stem}_claim_1", "claim 1", len(lines[1].strip())))
        else:
            want += [(f"{d.id}_p{i:03d}", h, len(t)) for i, (h, t) in enumerate(groups(d.text.replace("\n", "\n\n")))]
    own = retrieval._statutes(spark, sf).where("source_type = 'statute'")
    want += [tuple(r) for r in chunking.chunk_statutes(own).select("id", "section", F.length("text")).collect()]
    got = [tuple(r) for r in retrieval.chunk_corpus(spark, sf).select("id", "section", "n_chars").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    bad = spark.createDataFrame([("poem",)], "t string")
    with pytest.raises(Exception, match="unsupported source_type poem"):
        bad.select(chunking.branch(F.col("t"))).collect()


def _record(name, main, given="x"):
    return f"{name} (churna)\n\nCategory: Powder\nMain ingredients: {main}\nIngredients: {given}\nReference: r\nIndications: i\n"


def test_formulary_learns_names_and_binomials_in_order(spark):
    text = _record("One", "Guduchi") + _record("Two", "Guduchi, Salt", "Guduchi (Tinospora cordifolia)") + _record("Three", "guduchi, Tinospora cordifolia") + _record("Four", "Neem", "Neem (Melia azedarach), Neem (Azadirachta indica)")
    herbs, forms = (spark.createDataFrame([x], "term string, key string") for x in (("tulsi", "Herb:t"), ("two", "Formulation:two")))
    docs = spark.createDataFrame([("f", "Book", text), ("g", "Book", _record("Five", "Guduchi, two"))], "id string, title string, text string")
    rows = {(r.id, r.pos, r.ingredient): (r.target, r.new_herb) for r in kg.parse_formulary(docs, herbs, forms).collect()}
    assert rows == {
        ("f", 0, "Guduchi"): ("Ingredient:guduchi", None), ("f", 1, "Guduchi"): ("Herb:tinospora cordifolia", "Tinospora cordifolia"), ("f", 1, "Salt"): ("Ingredient:salt", None),
        ("f", 2, "guduchi"): ("Herb:tinospora cordifolia", None), ("f", 2, "Tinospora cordifolia"): ("Herb:tinospora cordifolia", None),
        ("f", 3, "Neem"): ("Herb:azadirachta indica", "Azadirachta indica"), ("g", 0, "Guduchi"): ("Ingredient:guduchi", None), ("g", 0, "two"): ("Formulation:two", None),
    }
    nodes, edges = kg.formulary_graph(docs, herbs, forms)
    assert edges.count() == edges.select("source", "target", "type").distinct().count() == 12
    assert {r.key for r in nodes.where("label = 'Herb'").collect()} == {"Herb:tinospora cordifolia", "Herb:azadirachta indica"}


def test_formulary_names_leave_a_text_once(spark):
    import pyarrow as pa

    text = "".join(_record(f"Mix {i}", "Tulsi, Salt", "Tulsi (Ocimum sanctum)") for i in range(500))
    (batch,) = kg._formulary_terms(iter([pa.RecordBatch.from_pydict({"id": ["f"], "text": [text]})]))
    assert batch.num_rows == 503 and {"tulsi", "salt", "ocimum sanctum"} <= set(batch.column(1).to_pylist())


def test_scoped_mentions_join_by_equal_columns(spark):
    docs = spark.range(400).select(F.struct(F.col("id").alias("case_id"), F.lit("s").alias("id")).alias("id"), F.lit("ghee and tulsi").alias("text"))
    own = spark.range(400).where("id % 2 = 0").select(F.lit("tulsi").alias("term"), F.lit("Herb:t").alias("key"), F.col("id").alias("scope"))
    found = kg.entity_mentions(docs, own.union(spark.createDataFrame([("ghee", "Ingredient:ghee", None)], "term string, key string, scope long")), "case_id")
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any(" OR " in x for x in joins)
    rows = {(r.id.case_id, r.key): r.n for r in found.collect()}
    assert rows == {(i, "Ingredient:ghee"): 1 for i in range(400)} | {(i, "Herb:t"): 1 for i in range(0, 400, 2)}


def _same_as_sql(spark, folder, name, tables):
    import duckdb

    from evidora.queries import ORACLES, QUERIES, load

    load()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()))


def _odd_texts(spark):
    return spark.createDataFrame([*enumerate(["a b", None, "", " ", "\n\t", "  ", "\x1c", '"', "x"] * 5)], "doc_id long, text string")


def test_export_of_empty_texts(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "patents_from_export", {"documents": _odd_texts(spark)})


def test_fulltext_of_empty_texts(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "patents_from_fulltext", {"documents": _odd_texts(spark)})


def test_documents_are_listed_in_tasks(spark, tmp_path):
    for path in ("a.txt", "deep/b.md", "deep/er/c.txt", "deep/er/.hidden.txt", ".git/d.txt", "_tmp/e.txt", "k=1/f.txt", "deep/note.doc"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"{at.name}\n")
        at.with_name(at.stem + ".meta.json").write_text('{"doc_id": "x", "source_type": "statute"}')
    (tmp_path / "deep/g.txt").write_text("alone")
    loaded, skipped = documents.load_documents(spark, f"file://{tmp_path}")
    assert "binaryfile" not in loaded._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r.path, r.text) for r in loaded.collect()} == {(f"file:{tmp_path}/{p}", p.rpartition("/")[2]) for p in ("a.txt", "deep/b.md", "deep/er/c.txt", "k=1/f.txt")}
    assert [tuple(r) for r in skipped.collect()] == [(f"file:{tmp_path}/deep/g.txt", "no sidecar")]


def test_evidence_of_claims_is_dealt_once(spark):
    from evidora.operators import formulation

    claims = spark.createDataFrame([(1, "A.", ["x", "y"], ["s", "t"]), (1, "b", ["x"], [])], "formulation_id int, claim string, subject_ids array<string>, candidate_ids array<string>")
    verdicts = spark.createDataFrame([(1, "a", "SUPPORTED", ["t"])], "formulation_id int, claim string, status string, evidence_source_ids array<string>")
    found = formulation.claim_evidence(claims, verdicts)
    assert [{tuple(r) for r in f.collect()} for f in found] == [{(1, "x", "probable"), (1, "y", "confirmed")}, {(1, "s", "UNSUPPORTED"), (1, "t", "SUPPORTED")}, {(1, "x", "t"), (1, "y", "t")}]
    assert not any("Exchange" in f._jdf.queryExecution().sparkPlan().toString() or "Exchange" in f._jdf.queryExecution().executedPlan().toString() for f in found)


def test_automata_stay_out_of_the_driver(spark, monkeypatch):
    from evidora.operators import automaton

    monkeypatch.setattr(automaton, "SHARD_TOKENS", 40)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda _: pytest.fail("an automaton goes through the driver"))
    docs = spark.range(60).select("id", F.concat(F.lit("red leaf "), "id", F.lit(" of red leaf")).alias("text"))
    terms = spark.range(60).select(F.explode(F.array(F.concat(F.lit("leaf "), "id"), F.lit("red leaf"), F.concat(F.lit("red leaf "), "id"))).alias("term")).distinct().withColumn("key", F.concat(F.lit("K:"), "term"))
    assert {(r.id, r.key): r.n for r in kg.entity_mentions(docs, terms).collect()} == {(i, f"K:red leaf {i}"): 1 for i in range(60)} | {(i, "K:red leaf"): 1 for i in range(60)}


def test_round_trip_reads_a_table_once_more(spark, monkeypatch):
    from evidora.sources import store

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, term string")
    found = store.index_round_trip({"t": rows})
    assert [tuple(r) for r in found.collect()] == [("t", 3, 0)]
    assert "Except" not in found._jdf.queryExecution().logical().toString()
    other = spark.createDataFrame([(1, "a"), (3, "c")], "id int, term string")
    monkeypatch.setattr(store, "written", lambda df, name: other)
    assert [tuple(r) for r in store.index_round_trip({"t": rows}).collect()] == [("t", 2, 3)]


def test_merged_edges_look_their_ends_up_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "key string")
    kind = "source string, target string, type string, props map<string,string>"
    old = spark.createDataFrame([("a", "b", "CITES", {"x": "1", "y": "2"}), ("b", "a", "CITES", {})], kind).withColumn("origin", F.lit("curated"))
    batch = spark.createDataFrame([("a", "b", "CITES", {"x": "3", "y": None, "origin": "z"}), ("a", "b", "CITES", {"x": "4"}), ("a", "a", "CITES", {}), ("a", "c", "CITES", {}), ("b", "a", "CONTAINS", None)], kind).coalesce(1)
    merged = kg.merge_edges(old, batch, nodes, "pipeline")
    assert {(r.source, r.target, r.type): (r.props, r.origin) for r in merged.collect()} == {("a", "b", "CITES"): ({"x": "4", "y": "2"}, "curated"), ("b", "a", "CITES"): ({}, "curated"), ("b", "a", "CONTAINS"): ({}, "pipeline")}
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4  # two ends, of old and new edges
