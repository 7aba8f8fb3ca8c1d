"""Queries over chunking, search, filters and fusion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, dense, filters, fusion, ivf, lexical, statutes
from ..queries import query
from ..sources.store import index_round_trip, written
from .adapters import CHUNKS_SQL, QUERIES_SQL, chunks, indexed_chunks, queries, sql_list, table, tokens_sql


@query("tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_POSTINGS = f"tok AS (SELECT id, {tokens_sql('text')} AS t FROM {CHUNKS_SQL}), dl AS (SELECT id, len(t) AS dl FROM tok), post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL)"
_TERMS = "n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term), terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"
_ASKED = f"asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM {QUERIES_SQL}) GROUP BY ALL)"
_SCORED = "scored AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN terms USING (term) JOIN post USING (term) JOIN dl USING (id), n GROUP BY ALL HAVING sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0)"
_INDIA = "((coalesce(legal_scope, 'domestic') = 'domestic') AND lower(trim(coalesce(jurisdiction, ''))) IN ('', 'india'))"


def _india():
    return filters.scope_filter(F.col("legal_scope"), F.col("jurisdiction"), F.lit("domestic"), F.lit("India"))


@query("bm25_index", f"WITH {_POSTINGS}, {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_index(spark, sf_dir):
    return lexical.terms(indexed_chunks(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "bm25_search",
    f"WITH {_POSTINGS}, {_TERMS}, {_ASKED}, {_SCORED}, hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored JOIN {CHUNKS_SQL} USING (id) WHERE {_INDIA}) SELECT query_id, rank, id, round(score, 6) AS score FROM hits WHERE rank <= 30",
)
def bm25_search(spark, sf_dir):
    found = lexical.bm25_search(chunks(spark, sf_dir), F.col("text"), queries(spark, sf_dir), 30, _india(), indexed_chunks(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query("bm25_rebuild", f"WITH {_POSTINGS} SELECT 'postings' AS part, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM post UNION ALL SELECT 'lengths', count(*), 0 FROM dl")
def bm25_rebuild(spark, sf_dir):
    tok = written(lexical.tokens(chunks(spark, sf_dir), F.col("text")), "tokens")  # texts are cut once
    return index_round_trip({"postings": lexical.postings(tok), "lengths": lexical.doc_lengths(tok)})


_FLAGS = "FROM (SELECT * FROM {c})".format(c=CHUNKS_SQL)


@query("scope_filter", f"SELECT id, {_INDIA} AS domestic_india, coalesce(legal_scope, 'domestic') = 'domestic' AS domestic_any, coalesce(legal_scope, 'domestic') = 'international' AS international {_FLAGS}")
def scope_filter(spark, sf_dir):
    row = F.col("legal_scope"), F.col("jurisdiction")
    none = F.lit(None).cast("string")
    return chunks(spark, sf_dir).select("id", _india().alias("domestic_india"), filters.scope_filter(*row, none, none).alias("domestic_any"), filters.scope_filter(*row, F.lit("International"), F.lit("india")).alias("international"))


@query("source_type_filter", f"SELECT source_type, count(*) AS n {_FLAGS} WHERE source_type IN ('statute', 'patent') GROUP BY 1")
def source_type_filter(spark, sf_dir):
    return chunks(spark, sf_dir).where(filters.source_type_filter(F.col("source_type"), [" Statute", "patent", "", "PATENT "])).groupBy("source_type").agg(F.count("*").alias("n"))


@query("dense_prefilter", f"SELECT id, legal_scope {_FLAGS} WHERE legal_scope = 'international' AND source_type IN ('guideline', 'prior_art')")
def dense_prefilter(spark, sf_dir):
    keep = filters.dense_prefilter(F.col("legal_scope"), F.col("jurisdiction"), F.col("source_type"), "international", "epo", ["guideline", "prior_art"])
    return chunks(spark, sf_dir).where(keep).select("id", "legal_scope")


@query("section_label_filter", f"SELECT id, section {_FLAGS} WHERE source_type = 'statute' AND section IN {tuple(['3', *filters.SECTION3_CLAUSES])}")
def section_label_filter(spark, sf_dir):
    return chunks(spark, sf_dir).where(filters.section_label_filter(F.col("source_type"), F.col("section"))).select("id", "section")


_DOMAINS = ["example.com", "example.org", "wiki.example.net"]


@query("domain_allowlist", "SELECT page_id, url FROM pages WHERE " + " OR ".join(f"lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) = '{d}' OR lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) LIKE '%.{d}'" for d in _DOMAINS))
def domain_allowlist(spark, sf_dir):
    return filters.domain_allowlist(table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame([(d,) for d in _DOMAINS], "domain string"))


@query("clean_lines", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t\x{00A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM documents""")
def clean_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_lines(F.col("text"))).alias("clean_md5"))


def _guidelines(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return c.withColumn("doc_id", F.col("id"))


_PARAS = r"paras AS (SELECT id, title, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM " + CHUNKS_SQL + ")"
_GROUPS = (
    "WITH RECURSIVE " + _PARAS + r""", flat AS (SELECT id, i, p[i] AS para, length(p[i]) <= 120 AND NOT regexp_matches(p[i], '[.;:,]\s*$') AND NOT contains(p[i], chr(10)) AS head FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM paras)),
st AS (SELECT id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS g, CAST(0 AS BIGINT) AS size, false AS taken, CAST(NULL AS VARCHAR) AS heading, true AS shut FROM paras
 UNION ALL SELECT st.id, flat.i,
  CASE WHEN NOT head AND (st.shut OR st.size + length(para) > 1500) THEN st.g + 1 ELSE st.g END,
  CASE WHEN head THEN 0 WHEN st.shut OR st.size + length(para) > 1500 THEN length(para) ELSE st.size + length(para) END,
  NOT head, CASE WHEN head THEN para ELSE st.heading END, head
 FROM st JOIN flat ON flat.id = st.id AND flat.i = st.i + 1),
g AS (SELECT st.id, g, any_value(st.heading) AS section, string_agg(para, chr(10) || chr(10) ORDER BY st.i) AS text FROM st JOIN flat ON flat.id = st.id AND flat.i = st.i WHERE taken GROUP BY st.id, g)
"""
)


@query("chunk_guidelines", _GROUPS + "SELECT g.id || '_p' || CASE WHEN g < 1000 THEN lpad(CAST(g AS VARCHAR), 3, '0') ELSE CAST(g AS VARCHAR) END AS id, section, md5(CASE WHEN section IS NULL THEN title ELSE title || ' — ' || section END) AS title_md5, md5(g.text) AS text_md5 FROM g JOIN paras ON paras.id = g.id")
def chunk_guidelines(spark, sf_dir):
    return chunking.chunk_guidelines(_guidelines(spark, sf_dir)).select("id", "section", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"))


def _patents(spark, sf_dir):
    d = chunks(spark, sf_dir)
    lines = F.split(F.col("text"), "\n")
    return d.select(
        F.concat(F.lit("US-"), "doc_id", F.lit("/A1")).alias("publication_number"),
        F.element_at(lines, 1).alias("title"),
        F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n").alias("abstract"),
        F.when(F.col("doc_id") % 3 == 0, F.get(lines, F.lit(1))).otherwise(F.lit("  ")).alias("first_claim"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://example.org/"), "doc_id")).alias("url"),
        F.lit(None).cast("string").alias("publication_date"),
        F.lit(None).cast("string").alias("record_jurisdiction"),
        "source_type", F.lit("https://example.org/all").alias("source_url"), F.lit("2020-01-01").alias("effective_date"), "jurisdiction", "legal_scope", "is_fixture",
    )


_PATENT_SQL = rf"""WITH r AS (SELECT doc_id, 'patent_us_' || doc_id || '_a1' AS stem, string_split(text, chr(10)) AS l FROM documents),
 p AS (SELECT stem || '_abstract' AS id, l[1] || ' (US-' || doc_id || '/A1)' AS title, array_to_string(l[2:], chr(10)) AS text, 'abstract' AS section, doc_id FROM r
  UNION ALL SELECT stem || '_claim_1', l[1] || ' (US-' || doc_id || '/A1)', l[2], 'claim 1', doc_id FROM r WHERE doc_id % 3 = 0 AND regexp_replace(coalesce(l[2], ''), '^\s+|\s+$', '', 'g') <> '')
 SELECT id, md5(title) AS title_md5, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5, section, CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id ELSE 'https://example.org/all' END AS source_url FROM p"""


@query("chunk_patents", _PATENT_SQL)
def chunk_patents(spark, sf_dir):
    return chunking.chunk_patents(_patents(spark, sf_dir)).select("id", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"), "section", "source_url")


def _statutes(spark, sf_dir):
    """Documents as statutes: every line numbered, every third one a clause."""
    c = _guidelines(spark, sf_dir)
    lines = F.split(F.replace("text", F.lit("\n\n"), F.lit("\n")), "\n")
    marked = F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat((i / 3 + 1).cast("int").cast("string"), F.lit(". "), x)).otherwise(F.concat(F.lit("("), F.when(i % 3 == 1, F.lit("a")).otherwise(F.lit("d")), F.lit(") "), x)))
    return c.withColumns({"text": F.array_join(marked, "\n"), "section_prefix": F.lit("1"), "section_label_prefix": F.lit(None).cast("string")})


_FOOTNOTE = (
    r"^\s*\d+\.\s+(?:(?:Ins|Subs|Rep|Omitted|Omit|Added|Renumbered|Inserted|Substituted)\b|(?:The|Certain) words\b|The proviso\b|The Explanation\b|Sub-sections?\b|Sub-clauses?\b|Clauses?\b"
    r"|Chapter\b|For (?:section|sub-section|clause|the)\b|Came into force\b|See\b|Vide\b|\d{1,2}(?:st|nd|rd|th)\s+\w+,?\s+\d{4}|.*\bw\.e\.f\.)"
)
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: Rows (id, pos, text, role) of the statutes' lines, and what is made of them: sections, clauses and chunks.
_STATUTE = rf"""src AS (SELECT id, list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN CAST((i - 1) // 3 + 1 AS VARCHAR) || '. ' WHEN 1 THEN '(a) ' ELSE '(d) ' END || x) AS given FROM {CHUNKS_SQL}),
 cut AS (SELECT id, regexp_split_to_array(array_to_string(given, chr(10)), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM src),
 raw AS (SELECT id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM cut),
 bare AS (SELECT *, replace(regexp_replace(raw, '^\s*#{{1,6}}\s+', ''), '**', '') AS b FROM raw),
 line AS (SELECT id, pos, raw, regexp_replace(regexp_replace(b, '(^|[^\pL\pN\pM_])_([^\s_])', '\1\2', 'g'), '([^\s_])_([^\pL\pN\pM_]|$)', '\1\2', 'g') AS line FROM bare),
 kinds AS (SELECT *, {_STRIP.format("line")} AS words, CASE WHEN regexp_matches(line, '^\s*(?:\d{{1,4}}\s+)?-{{3,}}\s*$') OR regexp_matches(raw, '^\s*_{{3,}}\s*$') THEN 'end'
   WHEN regexp_matches(line, '{_FOOTNOTE}') AND NOT regexp_matches(raw, '^\s*\*\*') THEN 'note'
   WHEN regexp_matches(raw, '^\s*(?:\*\*|(?:\d+\[)?\((?:[a-z]{{1,4}}|\d{{1,3}}[A-Z]?)\)\s|(?:\d+\[)?\d{{1,3}}(?:-?[A-Z]{{1,3}})?\.\s|(?:\d+\[)?CHAPTER\b)') THEN 'start' END AS kind FROM line),
 noted AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER w = 'note', false) AS noting FROM kinds WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 first AS (SELECT *, CASE WHEN kind = 'end' THEN NULL WHEN kind = 'note' THEN 'note' WHEN noting AND kind IS NULL THEN CASE WHEN words <> '' AND NOT regexp_matches(line, '^\s*\d{{1,4}}\s*$') THEN 'more' END
   WHEN regexp_matches(line, '^\s*\d*\*[\s\-.*]*$') THEN 'omission' WHEN regexp_matches(line, '^\s*(?:\d+\[)?CHAPTER\s+[IVXLC]+[A-Z]?\]?\s*$') THEN 'chapter' WHEN words = '' THEN 'blank' ELSE 'text' END AS r FROM noted),
 titled AS (SELECT *, coalesce(last_value(CASE WHEN r IN ('chapter', 'text') THEN r END IGNORE NULLS) OVER w = 'chapter', false) AND (r = 'blank' OR (r = 'text' AND regexp_matches(regexp_replace(words, '[^A-Za-z]', '', 'g'), '^[A-Z]+$'))) AS title FROM first WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 role AS (SELECT id, pos, CASE WHEN r = 'omission' THEN '[omission marker] ' || words WHEN r IN ('note', 'more') THEN words ELSE regexp_replace(line, '\s+$', '') END AS text,
   CASE WHEN r IN ('text', 'blank') AND NOT title THEN 'body' WHEN r = 'omission' THEN 'note' WHEN r IN ('note', 'more') THEN r END AS role FROM titled),
 mine AS (SELECT * FROM role WHERE role IS NOT NULL),
 body AS (SELECT id, pos, text, max(CASE WHEN text <> '' THEN pos END) OVER (PARTITION BY id) AS last FROM mine WHERE role = 'body'),
 heads AS (SELECT *, nullif(regexp_extract(CASE WHEN pos = last THEN text ELSE text || chr(10) END, '^\s*(?:\d+\[)?(\d{{1,3}}(?:-?[A-Z]{{1,3}})?)\.\s', 1), '') AS number FROM body),
 parts AS (SELECT *, count(number) OVER (PARTITION BY id ORDER BY pos) AS part, count(number) OVER (PARTITION BY id) AS parts FROM heads),
 rows AS (SELECT id, part, pos, text, CASE WHEN parts > 0 THEN number ELSE '1' END AS number FROM parts WHERE part > 0 OR parts = 0),
 sections AS (SELECT id, part, arg_min(number, pos) AS number, string_agg(text, chr(10) ORDER BY pos) AS text FROM (SELECT *, coalesce(number, '') AS filled FROM rows) GROUP BY id, part)"""
_CLAUSES = r""",
 live AS (SELECT r.id, r.part, r.text, row_number() OVER w AS place, count(*) OVER (PARTITION BY r.id, r.part) AS n FROM (SELECT *, max(CASE WHEN text <> '' THEN pos END) OVER (PARTITION BY id, part) AS last FROM rows) AS r WHERE pos <= last WINDOW w AS (PARTITION BY r.id, r.part ORDER BY pos)),
 marks AS (SELECT *, lead(letter) OVER (PARTITION BY id, part ORDER BY place) AS following FROM (SELECT id, part, place, regexp_extract(CASE WHEN place < n THEN text || chr(10) ELSE text END, '^\s*(?:\d+\[)?\(([a-z]{1,4})\)\s', 1) AS letter FROM live) WHERE letter <> ''),
 chosen AS (SELECT id, part, list_reduce(list_prepend('', list(place || ':' || letter || ':' || CASE WHEN letter IN ('i', 'v', 'x') THEN CASE WHEN coalesce(following IN ('ii', 'iii', 'iv', 'vi', 'vii', 'viii', 'ix', 'xi'), false) THEN 'never' ELSE 'next' END ELSE 'any' END ORDER BY place)),
   lambda a, m: CASE WHEN string_split(m, ':')[2] > right(a, 1) AND (string_split(m, ':')[3] = 'any' OR (string_split(m, ':')[3] = 'next' AND (a = '' OR ascii(string_split(m, ':')[2]) = ascii(right(a, 1)) + 1))) THEN a || ',' || string_split(m, ':')[1] || ':' || string_split(m, ':')[2] ELSE a END) AS taken FROM marks WHERE length(letter) = 1 GROUP BY id, part),
 cuts AS (SELECT DISTINCT id, part, 0 AS i, 1 AS place, CAST(NULL AS VARCHAR) AS letter FROM live UNION ALL SELECT id, part, i, CAST(string_split(c, ':')[1] AS BIGINT), string_split(c, ':')[2] FROM (SELECT id, part, unnest(range(1, len(string_split(taken, ',')))) AS i, unnest(string_split(taken, ',')[2:]) AS c FROM chosen WHERE taken <> '')),
 spans AS (SELECT *, lead(place) OVER (PARTITION BY id, part ORDER BY i) AS until FROM cuts),
 clauses AS (SELECT s.id, s.part, letter, regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY live.place), ''), '^\s+|\s+$', '', 'g') AS text FROM spans AS s LEFT JOIN live ON live.id = s.id AND live.part = s.part AND live.place >= s.place AND live.place < coalesce(s.until, live.n + 1) GROUP BY s.id, s.part, s.i, letter),
 pieces AS (SELECT c.id, c.part, number, letter, c.text FROM clauses AS c JOIN sections AS s ON s.id = c.id AND s.part = c.part WHERE letter IS NOT NULL OR c.text <> ''),
 statute_chunks AS (SELECT id || '_' || regexp_replace(regexp_replace(lower(number), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || CASE WHEN letter IS NULL THEN '' ELSE '_' || letter END AS id, number || CASE WHEN letter IS NULL THEN '' ELSE '(' || letter || ')' END AS section, text, id AS doc FROM pieces
   WHERE letter IS NULL OR NOT regexp_matches(regexp_replace(regexp_replace(text, '^\s*(?:\d+\[)?\(([a-z])\)\s', ''), '\d+|[\[\]().;,:\-—\s]', '', 'g'), '(?i)^(?:omitted|\**$)'))"""


@query("chunk_statutes", f"WITH {_STATUTE}{_CLAUSES} SELECT id, section, md5(text) AS text_md5 FROM statute_chunks")
def chunk_statutes(spark, sf_dir):
    return chunking.chunk_statutes(_statutes(spark, sf_dir)).select("id", "section", F.md5("text").alias("text_md5"))


@query(
    "normalize_statute",
    f"""WITH {_STATUTE}, numbered AS (SELECT *, sum(CASE WHEN role = 'note' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS note FROM mine), notes AS (SELECT id, note, string_agg(text, ' ' ORDER BY pos) AS text FROM numbered WHERE role <> 'body' GROUP BY id, note),
 all_notes AS (SELECT id, count(*) AS n, string_agg(text, chr(10) ORDER BY note) AS text FROM notes GROUP BY id), bodies AS (SELECT id, {_STRIP.format("string_agg(text, chr(10) ORDER BY pos)")} AS text FROM mine WHERE role = 'body' GROUP BY id)
 SELECT src.id AS doc_id, md5(coalesce(b.text, '')) AS body_md5, coalesce(n.n, 0) AS n_notes, md5(coalesce(n.text, '')) AS notes_md5 FROM src LEFT JOIN bodies AS b ON b.id = src.id LEFT JOIN all_notes AS n ON n.id = src.id""",
)
def normalize_statute(spark, sf_dir):
    found = statutes.normalize_statutes(_statutes(spark, sf_dir).withColumn("doc_id", F.col("id")))
    return found.select("doc_id", F.md5("body").alias("body_md5"), F.size("notes").cast("long").alias("n_notes"), F.md5(F.array_join("notes", "\n")).alias("notes_md5"))


def _sections(spark, sf_dir):
    return statutes.split_sections(_statutes(spark, sf_dir).withColumn("doc_id", F.col("id")))


@query("split_sections", f"WITH {_STATUTE} SELECT id AS doc_id, part, number, md5(text) AS text_md5 FROM sections")
def split_sections(spark, sf_dir):
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return _sections(spark, sf_dir).select("doc_id", "part", "number", F.md5(text).alias("text_md5"))


@query("split_clauses", f"WITH {_STATUTE}{_CLAUSES} SELECT id AS doc_id, part, number, letter, md5(text) AS text_md5 FROM pieces")
def split_clauses(spark, sf_dir):
    return statutes.split_clauses(_sections(spark, sf_dir)).select("doc_id", "part", "number", "letter", F.md5("text").alias("text_md5"))


_PATENT_TEXTS = _PATENT_SQL[_PATENT_SQL.index("WITH ") + 5 : _PATENT_SQL.rindex(" SELECT id, md5(title)")]


@query(
    "chunk_corpus",
    _GROUPS.rstrip() + f""", {_STATUTE}{_CLAUSES}, {_PATENT_TEXTS}, kinds_of AS (SELECT id, doc_id, source_type FROM {CHUNKS_SQL})
 SELECT c.id, section, length(text) AS n_chars FROM statute_chunks AS c JOIN kinds_of AS k ON k.id = c.doc WHERE source_type = 'statute'
 UNION ALL SELECT g.id || '_p' || CASE WHEN g < 1000 THEN lpad(CAST(g AS VARCHAR), 3, '0') ELSE CAST(g AS VARCHAR) END, section, length(g.text) FROM g JOIN kinds_of AS k ON k.id = g.id WHERE source_type NOT IN ('statute', 'patent')
 UNION ALL SELECT p.id, section, length({_STRIP.format("text")}) FROM p JOIN kinds_of AS k ON k.doc_id = p.doc_id WHERE source_type = 'patent'""",
)
def chunk_corpus(spark, sf_dir):
    makers = {"statute": _statutes, "guideline": _guidelines, "patent": _patents}
    parts = [make(spark, sf_dir).where(chunking.branch(F.col("source_type")) == kind) for kind, make in makers.items()]
    return chunking.chunk_corpus(*parts).select("id", "section", F.length("text").cast("long").alias("n_chars"))


@query("chunk_keys", rf"""WITH k AS (SELECT id, title || chr(10) || CASE WHEN section IS NULL THEN '' ELSE 'Section ' || section || chr(10) END || text AS index_text, sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode('chunk:' || id)) AS h FROM {CHUNKS_SQL})
 SELECT id, md5(index_text) AS index_md5, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17:17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM k""")
def chunk_keys(spark, sf_dir):
    return chunking.chunk_keys(chunks(spark, sf_dir)).select("id", F.md5("index_text").alias("index_md5"), "point_id")


_BUCKETS = "bk AS (SELECT id, b, count(*) AS n FROM (SELECT id, ('0x' || right(md5(term), 7))::BIGINT % 64 AS b FROM (SELECT id, unnest(t) AS term FROM tok)) GROUP BY ALL), nm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM bk GROUP BY id)"


@query("hash_embed", f"WITH tok AS (SELECT id, {tokens_sql('text')} AS t FROM {CHUNKS_SQL}), {_BUCKETS} SELECT tok.id, count(b) AS filled, round(coalesce(sum(n / norm * (b + 1)), 0), 6) AS weighted FROM tok LEFT JOIN bk ON tok.id = bk.id LEFT JOIN nm ON tok.id = nm.id GROUP BY tok.id")
def hash_embed(spark, sf_dir):
    v = dense.hash_embed(chunks(spark, sf_dir), F.col("text"))
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("filled"), F.round(weighted, 6).alias("weighted"))


@query("check_vectors", "SELECT count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) > 0 AS ok FROM embeddings")
def check_vectors(spark, sf_dir):
    return dense.check_vectors(table(spark, sf_dir, "embeddings")).select("n", F.col("min_dim").cast("long").alias("min_dim"), F.col("max_dim").cast("long").alias("max_dim"), "ok")


@query(
    "dense_search",
    "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.id AS query_id, v.id, round(coalesce(list_cosine_similarity(q.e, v.e), 0), 12) AS score FROM v, v AS q WHERE q.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 30",
)
def dense_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return dense.dense_search(v, asked, 30).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query("dense_search_ivf")
def dense_search_ivf(spark, sf_dir):
    """The same searches with an inverted file; two of three cells are looked into, as the table's vectors hardly form groups."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = ivf.build(v)
    probes = -(-2 * index.size() // 3)
    return ivf.search(index, v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 30, probes).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query("rrf_fuse", "WITH r AS (SELECT l_orderkey AS query_id, l_returnflag AS list_id, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_suppkey) AS pos, l_suppkey AS id FROM lineitem), b AS (SELECT query_id, list_id, id, min(pos) AS pos FROM r GROUP BY ALL), f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + pos)) AS score FROM b GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank, id, round(score, 9) AS score FROM f")
def rrf_fuse(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_suppkey")
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("list_id"), F.row_number().over(w).alias("pos"), F.col("l_suppkey").alias("id"))
    return fusion.rrf_fuse(r).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 9).alias("score"))


_DENSE = f"qtok AS (SELECT query_id AS id, {tokens_sql('query')} AS t FROM {QUERIES_SQL}), qb AS (SELECT id AS query_id, b, count(*) AS n FROM (SELECT id, ('0x' || right(md5(term), 7))::BIGINT % 64 AS b FROM (SELECT id, unnest(t) AS term FROM qtok)) GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qb GROUP BY 1), near AS (SELECT query_id, bk.id, round(sum(qb.n * bk.n) / any_value(qn.norm) / any_value(nm.norm), 12) AS score FROM qb JOIN bk ON qb.b = bk.b JOIN qn USING (query_id) JOIN nm ON nm.id = bk.id JOIN {CHUNKS_SQL} c ON c.id = bk.id WHERE {_INDIA} GROUP BY ALL), dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM near)"
_HYBRID = f"WITH {_POSTINGS}, {_TERMS}, {_ASKED}, {_SCORED}, {_BUCKETS}, {_DENSE}, br AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM scored JOIN {CHUNKS_SQL} USING (id) WHERE {_INDIA}), f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + pos)) AS score FROM (SELECT * FROM dr WHERE pos <= 30 UNION ALL SELECT * FROM br WHERE pos <= 30) GROUP BY ALL), h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank, id, score FROM f) "


def _hybrid(spark, sf_dir, top_k=8):
    c, q = chunks(spark, sf_dir), queries(spark, sf_dir)
    qv = dense.hash_embed(q.withColumnRenamed("query_id", "id"), F.col("query")).withColumnRenamed("id", "query_id")
    return fusion.hybrid_retrieve(c, F.col("text"), dense.hash_embed(c, F.col("text")), q.join(qv, "query_id"), _india(), top_k=top_k, indexed=indexed_chunks(spark, sf_dir))


@query("hybrid_retrieve", _HYBRID + "SELECT query_id, rank, id, round(score, 9) AS score FROM h WHERE rank <= 8")
def hybrid_retrieve(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 9).alias("score"))


_REL = "CAST(('0x' || right(md5(id || '/' || query_id), 6))::BIGINT AS DOUBLE) / 16777216"


@query("rerank", _HYBRID + f", c AS (SELECT query_id, id, rank, {_REL} AS rel FROM h WHERE rank <= 20), o AS (SELECT query_id, id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS r FROM c) SELECT query_id, r AS rank, id, round(rel, 9) AS score FROM o WHERE r <= 8")
def rerank(spark, sf_dir):
    fused = _hybrid(spark, sf_dir, 20)
    rel = F.conv(F.substring(F.md5(F.concat("id", F.lit("/"), F.col("query_id").cast("string"))), -6, 6), 16, 10).cast("double") / 16777216
    return fusion.rerank(fused, fused.select("query_id", "id", rel.alias("relevance"))).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 9).alias("score"))


@query("merge_sources", "WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_returnflag, l_linenumber, l_suppkey) AS n FROM lineitem) SELECT l_orderkey AS case_id, l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_suppkey) AS pos FROM f WHERE n = 1")
def merge_sources(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("id"), "l_returnflag", "l_linenumber")
    return fusion.merge_sources(h, ["case_id"], ["l_returnflag", "l_linenumber", "id"]).select("case_id", "id", F.col("pos").cast("long").alias("pos"))


def _web_hits(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select((F.col("page_id") % 50).alias("case_id"), F.concat(F.lit("q"), (F.col("page_id") % 7).cast("string")).alias("query"), (F.floor(F.col("page_id") / 50) + 1).alias("rank"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 9 != 0, F.col("url")).alias("url"), F.lit("s").alias("snippet"))


_WEB = "(SELECT page_id % 50 AS case_id, 'q' || page_id % 7 AS query, page_id // 50 + 1 AS rank, 't' || page_id AS title, CASE WHEN page_id % 9 <> 0 THEN url END AS url, 's' AS snippet FROM pages)"
_WEB_SRC = f"(SELECT *, 'web_' || sha1(coalesce(nullif(url, ''), title || '|' || snippet))[1:12] AS id, nullif(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '') AS section, greatest(0, round(1 - 0.05::DOUBLE * (rank - 1), 6)) AS score FROM {_WEB})"


@query("web_hits_to_sources", f"SELECT title, id, section, score FROM {_WEB_SRC}")
def web_hits_to_sources(spark, sf_dir):
    return fusion.web_hits_to_sources(_web_hits(spark, sf_dir)).select("title", "id", "section", "score")


@query("web_batch_merge", f"""WITH q AS (SELECT DISTINCT case_id, k AS pos, 'q' || k % 7 AS query, (case_id + k) % 5 = 0 AS failed FROM (SELECT DISTINCT case_id FROM {_WEB}), (SELECT unnest(range(9)) AS k)), u AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY case_id, query ORDER BY pos) = 1),
 m AS (SELECT s.case_id, s.id, u.pos AS query_pos, s.rank, s.title FROM {_WEB_SRC} s JOIN u ON u.case_id = s.case_id AND u.query = s.query WHERE NOT failed), f AS (SELECT *, row_number() OVER (PARTITION BY case_id, id ORDER BY query_pos, rank, title) AS n FROM m),
 e AS (SELECT case_id, count(*) FILTER (failed) AS failed_queries FROM u GROUP BY 1)
 SELECT e.case_id, f.id, CASE WHEN f.id IS NOT NULL THEN row_number() OVER (PARTITION BY e.case_id ORDER BY query_pos, rank, title) END AS pos, failed_queries FROM e LEFT JOIN (SELECT * FROM f WHERE n = 1) f USING (case_id)""")
def web_batch_merge(spark, sf_dir):
    hits = _web_hits(spark, sf_dir)
    asked = hits.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("pos"))
    asked = asked.select("case_id", "pos", F.concat(F.lit(" q"), (F.col("pos") % 7).cast("string"), F.lit(" ")).alias("query"), ((F.col("case_id") + F.col("pos")) % 5 == 0).alias("failed"))
    merged, errors = fusion.web_batch_merge(asked, hits)
    return errors.join(merged.select("case_id", "id", "pos"), "case_id", "left").select("case_id", "id", F.col("pos").cast("long").alias("pos"), "failed_queries")
