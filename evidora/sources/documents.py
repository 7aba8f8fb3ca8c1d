"""Reading documents, records and provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import batched

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_lines, norm_title, strip
from .store import written

SUFFIXES = ["txt", "md", "html", "htm", "pdf", "json", "jsonl"]
SOURCE_TYPES = ["statute", "guideline", "patent", "comparative_ip", "regulation", "case_law", "prior_art"]
META = "doc_id string, title string, source_type string, source_url string, effective_date string, jurisdiction string, legal_scope string, section_prefix string, section_label_prefix string, is_fixture boolean"
LISTED = 10_000  # names of a batch
READ_BYTES, TASK_BYTES = 1 << 23, 1 << 25
PATENT = "publication_number string, title string, abstract string, first_claim string, url string, publication_date string, jurisdiction string"


def write_documents(files: DataFrame, folder: str) -> int:
    """Write rows (path, content) as files below ``folder``, each in the task that has it; the number of files.

    ``folder`` is one that all executors share.  A repeated task writes the same
    files again; the contents of repeated paths must be equal.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                at = f"{base}/{path}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(at) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(dir, name, size) of all files below ``folder``: its folders are listed in tasks, a level at a time, and the driver holds none of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                for some in batched(fs.get_file_info(pyarrow.fs.FileSelector(path)), LISTED):
                    is_dir = [f.type == pyarrow.fs.FileType.Directory for f in some]
                    yield pd.DataFrame({"dir": [f"{path}/"] * len(some), "name": [f.base_name for f in some], "size": [f.size or 0 for f in some], "is_dir": [d and not _hidden(f.base_name) for d, f in zip(is_dir, some)], "is_file": [not d for d in is_dir]})

    files, level = None, spark.createDataFrame([(pyarrow.fs.FileSystem.from_uri(folder)[1].rstrip("/"),)], "path string")
    while level.limit(1).count():
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = written(level.repartition(n).mapInPandas(run, "dir string, name string, size long, is_dir boolean, is_file boolean"), "listing")
        own, level = found.where("is_file").select("dir", "name", "size"), found.where("is_dir").select(F.concat("dir", "name").alias("path"))
        files = own if files is None else files.unionByName(own)
    return files


def _contents(files: DataFrame, folder: str, schema: str) -> DataFrame:
    """``files`` (dir, name, beside, ...) with ``content`` and ``sidecar``, the bytes of a file and of the file ``beside`` it (or null), read in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)

        def read(path: str) -> bytes:
            with fs.open_input_stream(path, compression=None) as f:
                return f.read()

        for batch in batches:
            for _, some in batch.groupby(batch["size"].cumsum() // READ_BYTES, sort=False):
                content = [read(d + n) for d, n in zip(some["dir"], some["name"])]
                beside = [read(d + n) if n else None for d, n in zip(some["dir"], some["beside"])]
                yield some.assign(content=content, sidecar=beside)

    return files.mapInPandas(run, schema)


def _paired(spark: SparkSession, folder: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(dir, name, stem, suffix, beside, size) of documents, ``beside`` their sidecar's name or null, and what adds ``content`` and ``sidecar``."""
    files = _listed(spark, folder).where(~F.col("name").rlike("^[._]"))
    sidecar = F.col("name").endswith(".meta.json")
    beside = files.where(sidecar).select("dir", F.regexp_extract("name", r"^(.*)\.meta\.json$", 1).alias("stem"), F.col("name").alias("beside"))
    found = files.where(~sidecar).withColumns({"stem": F.regexp_extract("name", r"^(.*)\.[^.]+$", 1), "suffix": F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))}).where(F.col("suffix").isin(SUFFIXES))
    met = written(found.join(beside, ["dir", "stem"], "left").select("dir", "name", "suffix", "beside", "size"), "documents")
    total = met.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    schema = "dir string, name string, suffix string, beside string, size long, content binary, sidecar binary"
    return met, lambda some: _contents(some.repartition(tasks), folder, schema)


def load_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents (meta columns, path, suffix, text) with a sidecar, and what is skipped (path, reason).

    All folders below ``folder`` are searched.  A file needs ``<stem>.meta.json`` beside
    it; names that begin with a dot or underscore and other suffixes are no documents.
    HTML becomes text, lines are cleaned, bytes that are no UTF-8 become U+FFFD.  JSON
    keeps its text for ``read_patent_records`` and is an error for other source types.
    Texts without anything in them, and PDF (not decoded here), are skipped.
    """
    met, with_bytes = _paired(spark, folder)
    base = pyarrow.fs.FileSystem.from_uri(folder)[1].rstrip("/")
    head = folder.rstrip("/").removesuffix(base)
    path = F.concat(F.lit("file:" if head in ("", "file://") else head), "dir", "name").alias("path")
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    records = F.col("suffix").isin("json", "jsonl")
    wrong = records & ~F.coalesce(F.col("meta.source_type") == "patent", F.lit(False))
    raw = F.when(wrong, F.raise_error(F.concat("name", F.lit(": record files need source_type patent"))).cast("string")).otherwise(raw)
    meta = F.from_json(F.col("sidecar").cast("string"), META).alias("meta")

    def whole(which: str) -> DataFrame:
        some = with_bytes(met.where(f"beside IS NOT NULL AND suffix != 'pdf' AND suffix {which} ('html', 'htm')"))
        return some.select("name", "suffix", "content", path, meta).select("meta.*", "path", "suffix", raw.alias("raw"))

    pages = whole("IN")
    paged = html_to_text(pages, "raw").withColumn("text", clean_lines(F.col("text")))
    plain = whole("NOT IN").withColumn("text", F.when(records, F.col("raw")).otherwise(clean_lines(F.col("raw")))).drop("raw")
    texts = plain.unionByName(paged)
    full = strip(F.col("text")) != ""
    reason = F.when(F.col("beside").isNull(), "no sidecar").when(F.col("suffix") == "pdf", "pdf")
    skipped = met.select(path, reason.alias("reason")).where("reason IS NOT NULL").unionByName(texts.where(~full).select("path", F.lit("no text").alias("reason")))
    return texts.where(full), skipped


def metadata_reasons(known_types: list[str] = SOURCE_TYPES) -> Column:
    """array<string>: why a metadata row is invalid (empty if it is not)."""

    def bad(ok: Column, reason: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), reason)

    label = F.col("section_label_prefix")
    checks = [
        bad(F.col("doc_id").rlike(r"^[a-z0-9][a-z0-9_]*$"), "doc_id"),
        bad(label.isNull() | label.rlike(r"^[A-Z][A-Z0-9]{1,9}$"), "section_label_prefix"),
        bad(F.trim("jurisdiction") != "", "jurisdiction"),
        bad(F.col("source_type").isin(known_types), "source_type"),
        bad(F.col("legal_scope").isin("domestic", "international"), "legal_scope"),
    ]
    return F.array_compact(F.array(*checks))


def validate_metadata(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows with lower-case jurisdiction, and the others with their reasons."""
    rows = meta.withColumn("reasons", metadata_reasons())
    return rows.where(F.size("reasons") == 0).drop("reasons").withColumn("jurisdiction", F.lower(F.trim("jurisdiction"))), rows.where(F.size("reasons") > 0)


class _Blocks(HTMLParser):
    """Texts of block tags in document order; a block inside a block gives its text twice."""

    KEEP = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}
    SKIP = {"script", "style", "nav", "footer", "header", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.all: list[str] = []
        self.skipped: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skipped.append(tag)
        elif tag in self.KEEP and not self.skipped:
            if tag == "p":  # a new paragraph ends an open one
                self.open = [x for x in self.open if x[0] != "p"]
            self.blocks.append([])
            self.open.append((tag, self.blocks[-1]))

    def handle_endtag(self, tag: str) -> None:
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        self.all.append(data)
        for _, block in self.open:
            block.append(data)


def html_text(html: str) -> str:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    texts = [" ".join("".join(b).split()) for b in parser.blocks]
    found = "\n\n".join(t for t in texts if t)
    return found or "\n".join(t for t in (" ".join(x.split()) for x in parser.all) if t)


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the html column by ``text``; one page a row, no shuffle."""
    kept = [c for c in pages.columns if c not in (html, "text")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[kept].assign(text=[html_text(h) for h in f[html]])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string"])
    return pages.select(*kept, html).mapInPandas(run, schema)


def read_patent_records(docs: DataFrame) -> DataFrame:
    """Patent rows of documents (source_type, suffix, text): JSON array, object or lines; another type is an error."""
    checked = docs.withColumn("text", F.when(F.col("source_type") == "patent", F.col("text")).otherwise(F.raise_error(F.lit("record files need source_type patent"))))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    whole = F.from_json("text", f"array<struct<{PATENT}>>")
    each = F.transform(lines, lambda x: F.from_json(x, f"struct<{PATENT}>"))
    return checked.select(F.explode(F.when(F.col("suffix") == "jsonl", each).otherwise(whole)).alias("r")).select("r.*")


def patents_from_export(rows: DataFrame, jurisdiction: str) -> tuple[DataFrame, DataFrame]:
    """Patents of an export (number, title, abstract, url, date), and one row with the number skipped."""
    title = F.regexp_replace(strip(F.coalesce("title", F.lit(""))), r'^"+|"+$', "")
    clean = rows.select(F.col("number").alias("publication_number"), title.alias("title"), strip(F.coalesce("abstract", F.lit(""))).alias("abstract"), F.lit(None).cast("string").alias("first_claim"), F.nullif(F.trim("url"), F.lit("")).alias("url"), F.nullif(F.trim("date"), F.lit("")).alias("publication_date"), F.lit(jurisdiction).alias("jurisdiction"))
    ok = (F.col("title") != "") & (F.col("abstract") != "")
    return clean.where(ok), clean.agg(F.count_if(~ok).alias("skipped"), F.count_if(ok).alias("kept"))


def first_claim(claims: Column) -> Column:
    found = strip(F.regexp_extract(claims, r"(?s)(?:^|\s)1\s?\.\s*(.*?)(?=\s2\s?\.\s|\z)", 1))
    return F.nullif(found, F.lit(""))


def iso_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)))


def patents_from_fulltext(rows: DataFrame, jurisdiction: str) -> DataFrame:
    """Patents of full texts (number, title, abstract, claims, date) that have number, title and abstract."""
    ok = F.lit(True)
    for c in ("number", "title", "abstract"):
        ok &= F.trim(F.coalesce(c, F.lit(""))) != ""
    return rows.where(ok).select(F.col("number").alias("publication_number"), "title", "abstract", first_claim(F.coalesce("claims", F.lit(""))).alias("first_claim"), iso_date(F.col("date")).alias("publication_date"), F.lit(jurisdiction).alias("jurisdiction"))


def render_formulary(rows: DataFrame) -> Column:
    """A record as text in fixed order; absent fields drop out."""

    def line(head: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{head}: "), value))

    body = F.concat_ws("\n", line("Category", F.col("category")), line("Main ingredients", F.array_join("main", ", ")), line("Ingredients", F.array_join("ingredients", ", ")), line("Reference", F.col("reference")), line("Indications", F.col("indications")))
    return F.concat("name", F.when(F.coalesce("form", F.lit("")) != "", F.concat(F.lit(" ("), "form", F.lit(")"))).otherwise(""), F.lit("\n\n"), body)


def excerpt_by_anchor(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """(doc_id, spec_id, text) of specs (spec_id, doc_id, after, start, end): lines from the start anchor up to the end anchor.

    Anchors are patterns; ``after`` and ``end`` may be null.  A missing anchor is an error.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.join(specs, "doc_id")
    key = ["doc_id", "spec_id"]
    hit = lambda c: F.regexp_like("line", F.col(c))
    a = rows.groupBy(*key).agg(F.min(F.when(F.col("after").isNull(), F.lit(0)).when(hit("after"), F.col("pos"))).alias("p_after"))
    b = rows.join(a, key).where(F.col("pos") >= F.col("p_after")).groupBy(*key, "p_after").agg(F.min(F.when(hit("start"), F.col("pos"))).alias("p_start"))
    c = rows.join(b, key).where(F.col("pos") > F.col("p_start")).groupBy(*key).agg(F.min(F.when(hit("end"), F.col("pos"))).alias("p_end"))
    found = specs.join(a, key, "left").join(b.drop("p_after"), key, "left").join(c, key, "left")
    missing = F.col("p_start").isNull() | (F.col("end").isNotNull() & F.col("p_end").isNull())
    found = found.withColumn("p_start", F.when(missing, F.raise_error(F.concat(F.lit("anchor not found: "), F.col("spec_id").cast("string"))).cast("int")).otherwise(F.col("p_start")))
    cut = lines.join(found.select(*key, "p_start", "p_end"), "doc_id").where((F.col("pos") >= F.col("p_start")) & (F.col("p_end").isNull() | (F.col("pos") < F.col("p_end"))))
    return cut.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def checksums(content: Column) -> Column:
    """SHA-256 of the text as it is, with LF and with CRLF line ends."""
    lf = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.array(F.sha2(content, 256), F.sha2(lf, 256), F.sha2(F.replace(lf, F.lit("\n"), F.lit("\r\n")), 256))


def verify_checksums(files: DataFrame, recorded: DataFrame, strict: bool = False) -> DataFrame:
    """(path, ok) of files (path, text) against (path, sha256); strict: a mismatch is an error."""
    out = files.join(recorded, "path").select("path", F.array_contains(checksums(F.col("text")), F.col("sha256")).alias("ok"))
    return out.where(F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("checksum of "), "path")).cast("boolean")).otherwise(F.lit(True))) if strict else out


def byte_duplicates(files: DataFrame) -> DataFrame:
    """(sha256, kept, others): files (path, text) with equal bytes; the first path is kept."""
    g = files.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return g.select("sha256", F.element_at("paths", 1).alias("kept"), F.slice("paths", 2, 1_000_000).alias("others"))


def provenance_rows(docs: DataFrame) -> DataFrame:
    """One row a document: its id, source, hash and byte count."""
    return docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("output_sha256"), F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


def subset_by_topic(rows: DataFrame, keywords: str, class_prefix: str = "A61K", field_word: str = "PHARMA", drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose title matches and whose class or field does; personal columns are dropped."""
    topic = F.col("title").rlike(f"(?i){keywords}")
    kind = F.coalesce(F.col("class_code").startswith(class_prefix), F.lit(False)) | F.coalesce(F.upper("field").contains(field_word), F.lit(False))
    return rows.where(topic & kind).drop(*drop)


def subset_by_class(rows: DataFrame, prefix: str = "A61K36", limit: int = 30, order: str = "member") -> DataFrame:
    """The first rows, in archive order, whose class begins with the prefix (spaces and slashes aside)."""
    return rows.where(F.upper(F.translate("main_class", " /", "")).startswith(prefix)).orderBy(order).limit(limit)


def first_row_per_title(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row (by file, row) of each target title, and the titles without any.

    rows: file, row, title, ...; targets: title, target.
    """
    wanted = targets.select(norm_title(F.col("title")).alias("_t"), "target")
    met = rows.withColumn("_t", norm_title(F.col("title"))).join(wanted, "_t")
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy("file", "row"))).where("_n = 1").drop("_n", "_t")
    return first, wanted.join(met.select("_t"), "_t", "left_anti").select("target")
