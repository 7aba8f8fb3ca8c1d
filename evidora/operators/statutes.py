"""Grammar of consolidated statute texts, as rows of lines.

A line's kind comes from patterns; what depends on lines before it (whether a
footnote or a chapter heading is open, which section runs) is carried by windows
over the lines of one document.  Only the choice of clause letters is a fold,
over the few marked lines of one section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the texts' layout.
PREFIX = r"(?:\d+\[)?"
SECTION = rf"(?U)^\s*{PREFIX}(\d{{1,3}}(?:-?[A-Z]{{1,3}})?)\.\s"
CLAUSE = rf"(?U)^\s*{PREFIX}\(([a-z])\)\s"
MARKER = rf"(?U)^\s*{PREFIX}\(([a-z]{{1,4}})\)\s"
FOOTNOTE = (
    r"(?U)^\s*\d+\.\s+(?:(?:Ins|Subs|Rep|Omitted|Omit|Added|Renumbered|Inserted|Substituted)\b|(?:The|Certain) words\b|The proviso\b|The Explanation\b"
    r"|Sub-sections?\b|Sub-clauses?\b|Clauses?\b|Chapter\b|For (?:section|sub-section|clause|the)\b|Came into force\b|See\b|Vide\b"
    r"|\d{1,2}(?:st|nd|rd|th)\s+\w+,?\s+\d{4}|.*\bw\.e\.f\.)"
)
BREAK = r"(?U)^\s*(?:\d{1,4}\s+)?-{3,}\s*$"
RULE = r"(?U)^\s*_{3,}\s*$"
NUMBER = r"(?U)^\s*\d{1,4}\s*$"
OMISSION = r"(?U)^\s*\d*\*[\s\-.*]*$"
CHAPTER = rf"(?U)^\s*{PREFIX}CHAPTER\s+[IVXLC]+[A-Z]?\]?\s*$"
BODY = rf"(?U)^\s*(?:\*\*|{PREFIX}\((?:[a-z]{{1,4}}|\d{{1,3}}[A-Z]?)\)\s|{PREFIX}\d{{1,3}}(?:-?[A-Z]{{1,3}})?\.\s|{PREFIX}CHAPTER\b)"
ROMAN_LETTERS = ["i", "v", "x"]
ROMAN_NEXT = ["ii", "iii", "iv", "vi", "vii", "viii", "ix", "xi"]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_EDGES = r"(?U)^\s+|\s+$"
_DOC = ["doc_id", "_same"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def _plain(raw: Column) -> Column:
    """A line without Markdown headings, bold and italics."""
    bare = F.replace(F.regexp_replace(raw, r"(?U)^\s*#{1,6}\s+", ""), F.lit("**"), F.lit(""))
    return F.regexp_replace(bare, r"(?U)(?<![\w_])_(?=[^\s_])|(?<=[^\s_])_(?![\w_])", "")


def statute_lines(docs: DataFrame) -> DataFrame:
    """The lines of (doc_id, text), each with its ``role``: body, note (first line), more (of the note before), or none.

    A footnote goes on until a page break, a rule or a line that can begin body
    text; a chapter heading takes the next written line with it if that is all
    capitals.  The two do not touch each other.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("_same"), F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("pos", "raw"))
    lines = lines.withColumn("line", _plain(F.col("raw"))).withColumn("words", _strip(F.col("line")))
    ends = F.col("line").rlike(BREAK) | F.col("raw").rlike(RULE)
    note = ~ends & F.col("line").rlike(FOOTNOTE) & ~F.col("raw").rlike(r"(?U)^\s*\*\*")
    lines = lines.withColumn("kind", F.when(ends, "end").when(note, "note").when(F.col("raw").rlike(BODY), "start"))
    before = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    noting = F.coalesce(F.last("kind", ignorenulls=True).over(before) == "note", F.lit(False))
    skipped = (F.col("words") == "") | F.col("line").rlike(NUMBER)
    own = F.when(F.col("line").rlike(OMISSION), "omission").when(F.col("line").rlike(CHAPTER), "chapter").when(F.col("words") == "", "blank").otherwise("text")
    role = F.when(F.col("kind") == "end", None).when(F.col("kind") == "note", "note")
    lines = lines.withColumn("role", role.when(noting & F.col("kind").isNull(), F.when(~skipped, "more")).otherwise(own))
    titled = F.coalesce(F.last(F.when(F.col("role").isin("chapter", "text"), F.col("role")), ignorenulls=True).over(before) == "chapter", F.lit(False))
    letters = F.regexp_replace("words", "[^A-Za-z]", "")
    title = titled & ((F.col("role") == "blank") | (F.col("role") == "text") & letters.rlike("^[A-Z]+$"))
    role = F.when(F.col("role").isin("text", "blank") & ~title, "body").when(F.col("role") == "omission", "note").when(F.col("role").isin("note", "more"), F.col("role"))
    text = F.when(F.col("role") == "omission", F.concat(F.lit("[omission marker] "), "words")).when(F.col("role").isin("note", "more"), F.col("words")).otherwise(F.regexp_replace("line", r"(?U)\s+$", ""))
    return lines.select(*_DOC, "pos", text.alias("text"), role.alias("role"))


def _joined(rows: Column, between: str = "\n") -> Column:
    """The texts of an array of (pos, text) in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), between)


def normalize_statutes(docs: DataFrame) -> DataFrame:
    """(doc_id, body, notes): each text without layout, and what was taken out of it as notes."""
    so_far = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = statute_lines(docs).where("role IS NOT NULL").withColumn("note", F.when(F.col("role") != "body", F.sum(F.when(F.col("role") == "note", 1).otherwise(0)).over(so_far)))
    parts = lines.groupBy(*_DOC, "note").agg(F.collect_list(F.struct("pos", "text")).alias("rows"))
    parts = parts.select(*_DOC, "note", F.when(F.col("note").isNull(), _strip(_joined(F.col("rows")))).otherwise(_joined(F.col("rows"), " ")).alias("text"))
    found = parts.groupBy(*_DOC).agg(F.first(F.when(F.col("note").isNull(), F.col("text")), ignorenulls=True).alias("body"), F.collect_list(F.when(F.col("note").isNotNull(), F.struct(F.col("note").alias("pos"), "text"))).alias("rows"))
    every = docs.select("doc_id", F.xxhash64("text").alias("_same"))
    notes = F.transform(F.array_sort("rows"), lambda r: r["text"])
    return every.join(found, _DOC, "left").select("doc_id", F.coalesce("body", F.lit("")).alias("body"), F.coalesce(notes, F.array().cast("array<string>")).alias("notes"))


def split_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, number, part, rows) of each section of (doc_id, text, section_prefix), ``rows`` being its lines.

    Text before the first heading belongs to no section.  Without headings the
    whole text is the section ``section_prefix``; a null one is an error.
    """
    body = statute_lines(docs).where("role = 'body'").join(docs.select("doc_id", F.xxhash64("text").alias("_same"), "section_prefix").dropDuplicates(_DOC), _DOC)
    whole = Window.partitionBy(*_DOC)
    so_far = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("text") != "", F.col("pos"))).over(whole)
    ended = F.when(F.col("pos") == last, F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    body = body.where("text IS NOT NULL").withColumn("number", F.nullif(F.regexp_extract(ended, SECTION, 1), F.lit("")))
    body = body.withColumn("part", F.count("number").over(so_far)).withColumn("parts", F.count("number").over(whole))
    missing = F.raise_error(F.lit("no section headings and no section_prefix")).cast("string")
    body = body.where("part > 0 OR parts = 0").withColumn("number", F.when(F.col("parts") > 0, F.col("number")).otherwise(F.coalesce("section_prefix", missing)))
    return body.groupBy(*_DOC, "part").agg(F.min(F.struct("pos", "number"))["number"].alias("number"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"))


def _accepted(marks: Column) -> Column:
    """Of (at, letter, roman_next), those that begin a clause.

    Letters ascend.  One that is also a roman numeral must be the very next
    letter and must not open a list that goes on with (ii), (iii) ...
    """
    nothing = F.struct(F.lit("").alias("last"), F.expr("cast(array() AS array<struct<at:int,letter:string>>)").alias("taken"))

    def step(acc: Column, m: Column) -> Column:
        numeral = m["letter"].isin(ROMAN_LETTERS)
        next_letter = (acc["last"] == "") | (F.ascii(m["letter"]) - F.ascii(acc["last"]) == 1)
        good = (m["letter"] > acc["last"]) & (~numeral | next_letter & ~m["roman_next"])
        taken = F.concat(acc["taken"], F.array(F.struct(m["at"].alias("at"), m["letter"].alias("letter"))))
        return F.when(good, F.struct(m["letter"].alias("last"), taken.alias("taken"))).otherwise(acc)

    return F.aggregate(marks, nothing, step, lambda acc: acc["taken"])


def split_clauses(sections: DataFrame) -> DataFrame:
    """Adds ``letter`` (null: the text before the first clause) and ``text``, one row for each."""
    # Blank lines at the end of a section are not part of it.
    last = F.aggregate("rows", F.lit(-1), lambda a, r: F.when(r["text"] != "", r["pos"]).otherwise(a))
    s = sections.withColumn("rows", F.filter("rows", lambda r: r["pos"] <= last))
    ended = F.transform("rows", lambda r, i: F.struct((i + 1).alias("at"), F.when(i + 1 < F.size("rows"), F.concat(r["text"], F.lit("\n"))).otherwise(r["text"]).alias("text")))
    marked = F.transform(ended, lambda r: F.struct(r["at"].alias("at"), F.regexp_extract(r["text"], MARKER, 1).alias("letter")))
    s = s.withColumn("_marks", F.filter(marked, lambda m: m["letter"] != ""))
    following = F.transform("_marks", lambda m, i: F.struct(m["at"].alias("at"), m["letter"].alias("letter"), F.coalesce(F.get("_marks", i + 1)["letter"].isin(ROMAN_NEXT), F.lit(False)).alias("roman_next")))
    s = s.withColumn("_taken", _accepted(F.filter(following, lambda m: F.length(m["letter"]) == 1)))
    head = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("letter"))
    s = s.withColumn("_cuts", F.concat(F.array(head), "_taken"))
    s = s.select(*sections.columns[:-1], "rows", "_cuts", F.posexplode("_cuts").alias("_i", "_cut"))
    until = F.coalesce(F.get("_cuts", F.col("_i") + 1)["at"], F.size("rows") + 1)
    texts = F.slice("rows", F.col("_cut")["at"], until - F.col("_cut")["at"])
    out = s.select(*sections.columns[:-1], F.col("_cut")["letter"].alias("letter"), _strip(F.array_join(F.transform(texts, lambda r: r["text"]), "\n")).alias("text"))
    return out.where("letter IS NOT NULL OR text <> ''")


def is_omitted(clause: Column) -> Column:
    """Whether a clause is only a mark that it was omitted."""
    rest = F.regexp_replace(F.regexp_replace(clause, CLAUSE, ""), r"(?U)\d+|[\[\]().;,:\-—\s]", "")
    return rest.rlike(r"(?i)^(?:omitted|\**$)")
