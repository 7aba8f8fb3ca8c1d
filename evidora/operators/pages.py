"""Cleanup of page text, as rows of lines: page_lines(doc_id, page_no, line_no, line)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import repeat_key, strip

EDGE = 3
PROSE_CHARS, BLOCK_CHARS = 1500, 1200

# Patterns of the layout.
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?\s*$"
RULE = r"^\s*[-_=]{5,}\s*$"
BLOCK_START = r"^(?:\d{1,2}(?:\.\d{1,2})*\.?\s|\(?[a-z]\)\s|\(?[ivxl]{1,5}\)\s|[●•▪◦–-]\s|Section\s+\d|Explanation\b|Illustration\b|Example\b)"
TERMINAL = r"(?:[.:?!;]|\.[\"”’])$"
SENTENCE_END = r"(?<=[.;?!”\"])\s+(?=[\"“(A-Z0-9])"


def strip_page_furniture(lines: DataFrame, min_fraction: float = 0.3) -> DataFrame:
    """Lines without running heads and feet, page numbers and rules; white space collapsed."""
    rows = lines.where(strip(F.col("line")) != "").withColumn("key", repeat_key(F.col("line")))
    page = Window.partitionBy("doc_id", "page_no")
    rows = rows.withColumns({"_up": F.row_number().over(page.orderBy("line_no")), "_n": F.count("*").over(page)})
    rows = rows.withColumn("edge", (F.col("_up") <= EDGE) | (F.col("_up") > F.col("_n") - EDGE))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"))
    seen = rows.where("edge").select("doc_id", "key", "page_no").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("on"))
    repeated = seen.join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(3), F.floor(F.col("pages") * min_fraction))).select("doc_id", "key", F.lit(True).alias("_again"))
    kept = rows.join(repeated, ["doc_id", "key"], "left").where(~(F.col("edge") & F.coalesce("_again", F.lit(False))) & ~F.col("line").rlike(PAGE_NUMBER) & ~F.col("line").rlike(RULE))
    return kept.select("doc_id", "page_no", "line_no", F.regexp_replace(strip(F.col("line")), r"(?U)\s+", " ").alias("line"))


def pack_sentences(paragraph: Column, max_chars: int = PROSE_CHARS) -> Column:
    """The paragraph, or its sentences packed greedily up to max_chars."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) + 1 > max_chars)
        return F.struct(F.when(full, F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"]).alias("parts"), F.when(full, s).when(acc["cur"] != "", F.concat(acc["cur"], F.lit(" "), s)).otherwise(s).alias("cur"))

    packed = F.aggregate(F.split(paragraph, SENTENCE_END), start, step, lambda acc: F.when(acc["cur"] != "", F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"]))
    return F.when(F.length(paragraph) <= max_chars, F.array(paragraph)).otherwise(packed)


def split_long_paragraphs(paragraphs: DataFrame, max_chars: int = PROSE_CHARS) -> DataFrame:
    """(doc_id, para_no, part_no, text) of (doc_id, para_no, text)."""
    return paragraphs.select("doc_id", "para_no", F.posexplode(pack_sentences(F.col("text"), max_chars)).alias("part_no", "text"))


def reflow_prose(lines: DataFrame) -> DataFrame:
    """(doc_id, para_no, text): lines joined to paragraphs.

    A line begins a paragraph by its mark, or if the line before ends one: short
    and terminal, or a heading (very short, not terminal, and itself the first
    line of its paragraph).
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    median = lines.groupBy("doc_id").agg(F.median(F.length("line")).alias("median"))
    rows = lines.join(median, "doc_id").withColumn("i", F.row_number().over(order))
    prev = F.lag("line").over(order)
    ends = prev.rlike(TERMINAL) & (F.length(prev) < 0.85 * F.col("median"))
    headish = ~F.col("line").rlike(TERMINAL) & (F.length("line") < 0.6 * F.col("median"))
    rows = rows.withColumns({"base": F.coalesce(prev.isNull() | F.col("line").rlike(BLOCK_START) | ends, F.lit(False)), "headish": headish})
    # A run of heading-like lines right behind a certain start gives one paragraph each.
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("base"), F.col("i")), True).over(before)
    plain = F.last(F.when(~F.col("headish"), F.col("i")), True).over(before)
    rows = rows.withColumn("start", F.col("base") | (start > F.coalesce(plain, F.lit(0))))
    rows = rows.withColumn("para_no", F.sum(F.col("start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "para_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ").alias("text"))


def title_key(line: Column) -> Column:
    """The line as a monograph title (upper case, short, no sentence), else null."""
    s = strip(F.regexp_replace(line, r"^[\d\s:.]+", ""))
    letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(s, r"\P{Lu}", ""))
    ok = (letters >= 4) & (F.length(s) <= 70) & s.rlike(r"^\p{L}") & ~s.rlike(r"[.,;]$") & (upper >= 0.85 * letters)
    return F.when(ok, s)


def _pack_lines(lines: Column, max_chars: int) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["size"] + F.length(s) > max_chars)
        return F.struct(
            F.when(full, F.concat(acc["blocks"], F.array(F.array_join(acc["cur"], "\n")))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(full, F.array(s)).otherwise(F.concat(acc["cur"], F.array(s))).alias("cur"),
            F.when(full, F.length(s) + 1).otherwise(acc["size"] + F.length(s) + 1).alias("size"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.concat(acc["blocks"], F.array(F.array_join(acc["cur"], "\n"))))


def segment_monographs(lines: DataFrame, max_repeats: int = 3, max_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, page_no, seg_no, part_no, text): blocks of a page, split at titles that are rare in the document."""
    rows = lines.withColumn("title", title_key(F.col("line")))
    rows = rows.withColumn("_times", F.count("title").over(Window.partitionBy("doc_id", "title")))
    rows = rows.withColumn("is_title", F.col("title").isNotNull() & (F.col("_times") <= max_repeats))
    order = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    change = F.col("is_title") | F.coalesce(F.lag("is_title").over(order), F.lit(True))
    rows = rows.withColumn("_c", change.cast("int")).withColumn("seg_no", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shown = F.when(F.col("is_title"), F.col("title")).otherwise(F.col("line"))
    segs = rows.groupBy("doc_id", "page_no", "seg_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("s")))), lambda x: x["s"]).alias("ls"))
    return segs.select("doc_id", "page_no", "seg_no", F.posexplode(_pack_lines(F.col("ls"), max_chars)).alias("part_no", "text"))


# What glyphs of two legacy fonts stand for, and those that only the second one has.
FONT_A = {
    "¡": "ā", "¢": "ī", "£": "ū", "¤": "ṛ", "¸": "ṇ", "¶": "ṭ", "·": "ḍ", "À": "ṣ", "¿": "ś", "´": "ṅ", "Æ": "ṃ", "®": "e", "Å": "ḥ",
    "á": "Ś", "Ë": "Ā", "Ì": "Ī", "Í": "Ū", "Î": "Ṛ", "Ù": "Ṭ", "Û": "Ṇ", "Ú": "Ḍ", "â": "Ṣ", "Ø": "Ñ", "×": "Ṅ", "ê": "Ṃ",
}
FONT_B = {
    "¢": "ā", "¤": "ī", "¦": "ū", "º": "ś", "¾": "ṣ", "°": "ṭ", "¬": "ṅ", "´": "ṇ", "¼": "ṃ", "²": "ḍ", "¨": "ṛ", "®": "ñ", "ª": "ḥ",
    "¡": "Ā", "¥": "Ū", "³": "Ṇ", "½": "Ṣ", "¯": "Ṭ", "§": "Ṛ",
}
ONLY_B = "[¾¬¼²¨º¦¥³½¯§ª\u0100-\u024f\u1e00-\u1eff]"


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda w: None if w is None else unicodedata.normalize("NFC", w))


def restore_glyphs(words: DataFrame, fonts: str = "A", column: str = "word") -> DataFrame:
    """Adds ``restored``: words with legacy glyphs as the letters they stand for, in NFC; upper-case words stay so.

    The second font counts (if ``fonts`` has a B) for words with a glyph that it alone
    has, or a letter that is right already.  Micro, degree and plus-minus signs are
    letters only next to letters.  Works on the distinct words and joins them back.
    """
    known = words.select(column).where(F.col(column).isNotNull()).distinct()
    w = F.col(column)

    def mapped(table: dict[str, str], signs: dict[str, str]) -> Column:
        out = w
        for pattern, letter in signs.items():
            out = F.regexp_replace(out, pattern, letter)
        return F.translate(out, "".join(table), "".join(table.values()))

    micro = {r"(?<=\p{L})µ": "ñ"}
    first = mapped(FONT_A, {**micro, r"(?<=\p{L})°": "o"})
    second = mapped({**FONT_A, **FONT_B}, {**micro, r"±(?=\p{L})": "Ḍ"})
    out = F.when(w.rlike(ONLY_B), second).otherwise(first) if "B" in fonts else first
    out = F.when(w.rlike("[A-Z][^a-z]*[A-Z]") & ~w.rlike("[a-z]"), F.upper(out)).otherwise(out)
    out = F.coalesce(_composed(F.when(out.rlike(r"[^\x00-\x7f]"), out)), out)
    return words.join(known.withColumn("restored", out), column, "left")


# Marks of verse in legacy fonts.
VERSE_ANY = "[ÉÊ]"
VERSE_MARKS = [r"[;'\"~`\]}{/\\=Ò](?=\w)", r"\w[;\"`~\]]", r"\w~$", r"\.k", r"[a-z][A-Z][a-z]"]
VERSE_STRONG = r"[`~]|\w\"\w|\.k|[a-z][A-Z][a-z]"
UNIT_TOKEN = r"(?i)^\(?[\d.,]*[µμ]?[a-z]{1,3}/[a-z]{1,3}\)?[,.;:)]*$"
VERSE_NUMBER = r"AA\s*\d+\s*AA?\*?\s*$"
HALF_VERSE = r"\sAA?\*?\s*$"
SPAN = r"¼[^½\s]{2,30}½|¼[^½\s][^½]*?[;\"'`~\]/][^½]*?½"


def is_undecodable(line: Column, both_fonts: bool = True) -> Column:
    """Whether a line is verse in a font that cannot be decoded."""
    s = strip(line)
    if not both_fonts:
        return s.rlike(VERSE_ANY)
    tokens = F.split(s, r"\s+")

    def marks(t: Column) -> Column:
        n = F.lit(0)
        for p in VERSE_MARKS:
            n += t.rlike(p).cast("int")
        return F.when(t.rlike(UNIT_TOKEN), 0).otherwise(n)

    counts = F.transform(tokens, marks)
    hits = F.size(F.filter(counts, lambda n: n > 0))
    one = (F.size(tokens) == 1) & (F.length(s) >= 8) & (F.element_at(counts, 1) >= 2) & s.rlike(VERSE_STRONG)
    many = (F.size(tokens) > 1) & (hits / F.size(tokens) >= 0.4)
    return (s != "") & (s.rlike(VERSE_ANY) | s.rlike(VERSE_NUMBER) | ((hits > 0) & s.rlike(HALF_VERSE)) | one | many)


def drop_undecodable_lines(lines: DataFrame, both_fonts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines that can be read, and (doc_id, dropped)."""
    rows = lines
    if both_fonts:
        rows = rows.withColumn("line", F.regexp_replace(strip(F.regexp_replace("line", SPAN, " ")), r"\s+", " ")).where("line != ''")
    rows = rows.withColumn("_verse", is_undecodable(F.col("line"), both_fonts))
    return rows.where("NOT _verse").drop("_verse"), rows.groupBy("doc_id").agg(F.count_if("_verse").alias("dropped"))


def fix_chars(text: Column, replacements: list[tuple[str, str]]) -> Column:
    for old, new in replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def odd_characters(docs: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, rank, ch, n): the most common characters outside ASCII and outside U+0100 to U+1EFF."""
    odd = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x{00}-\x{7F}\x{100}-\x{1EFF}]"), 0)).alias("ch")).groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "ch")
    return odd.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
