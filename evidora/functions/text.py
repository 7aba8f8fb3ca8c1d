"""Text expressions: everything here is a Column, except ``fold`` for non-ASCII text and ``normal`` for tasks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words of the lexical index.
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were which with".split()
TOKEN = r"[a-z0-9]+(?:\([a-z]\))?"


def strip(c: Column) -> Column:
    """Without white space at both ends (all Unicode white space)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def normal(text: str) -> str:
    """``normalize`` of one text, inside a task."""
    return _SPACES.sub(" ", text.lower()).strip(" ")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def norm_title(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "^the ", "")


def repeat_key(c: Column) -> Column:
    """White space collapsed, digit runs as #, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", " "), r"\d+", "#"))


def clean_lines(c: Column) -> Column:
    """Lines with single spaces and no outer space; runs of blank lines as one; no outer blank lines."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t\u00A0]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Accented letters to their base letters (NFKD without combining marks)."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    return texts.map(one)


def tokens_of_folded(c: Column) -> Column:
    """Tokens of text that is already lower case and folded; stays in the JVM."""
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), 0), lambda t: ~t.isin(STOPWORDS))


def tokenize(c: Column) -> Column:
    """Tokens of a text; plain ASCII never leaves the JVM."""
    low = F.lower(F.coalesce(c, F.lit("")))
    other = fold(F.when(~low.rlike(r"^\p{ASCII}*$"), low))
    return tokens_of_folded(F.coalesce(other, low))
