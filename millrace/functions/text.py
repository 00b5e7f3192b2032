"""Text functions as Column expressions; all stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.identity import strip

LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def text(c: Column) -> Column:
    """Null as the empty string, without white space at the ends."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def lines(c: Column) -> Column:
    """The lines of a text by any line end; a last empty piece is dropped."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normal_code(c: Column) -> Column:
    """Code without white space at its ends and at line ends, with plain line ends."""
    one = F.regexp_replace(strip(c), LINE_END, "\n")
    return F.regexp_replace(one, r"(?U)[^\S\n]+\n", "\n")


def code_hash(c: Column) -> Column:
    return F.sha1(normal_code(F.coalesce(c, F.lit(""))))


def words(c: Column) -> Column:
    """A name in camel case or with separators as words with blanks between."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[_\-]+", " ")
    x = F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2")
    return strip(F.regexp_replace(x, r"\s+", " "))


def snake(c: Column) -> Column:
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1_$2")
    x = F.regexp_replace(x, r"[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(x, r"^_+|_+$", ""))


def path_tokens(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"[/_\-.]")
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def clean(c: Column) -> Column:
    """Plain line ends, no blanks before them, at most one empty line in a row."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits that the parts, null as empty, determine."""
    return F.left(F.sha1(F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts])), F.lit(16))


def _bits(texts):
    import numpy as np
    import pandas as pd

    def one(v):
        if v is None:
            return None
        n = np.unique(np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
        p = n / n.sum() if len(n) else n
        return float(-(p * np.log2(p)).sum()) + 0.0 if len(n) else 0.0

    return pd.Series([one(v) for v in texts], dtype="float64")


def entropy(c: Column) -> Column:
    """Bits a character, by one count of each text's characters; the empty text has 0, null gives null."""
    return F.pandas_udf(_bits, "double")(c)


def ordered_distinct(c: Column) -> Column:
    """Elements that are not blank, once each, in the order of first sight."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")))


def has_content(c: Column, kind: str) -> Column:
    """Whether a value of type ``kind`` says something: not null, no blank text, no empty collection; 0 and false do."""
    if kind == "string":
        return F.coalesce(F.length(strip(c)) > 0, F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def fence(c: Column) -> Column:
    """The longest fenced block of an answer, the first among equals; the whole answer where there is none."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)```(?:[a-z0-9_+-]*)[ \t]*\r?\n(.*?)```"), F.lit(1))
    best = F.array_max(F.transform(found, lambda x, i: F.struct(F.length(strip(x)).alias("n"), (-i).alias("i"), strip(x).alias("x"))))
    return F.when(c.isNull(), F.lit("")).when(F.size(found) > 0, best["x"]).otherwise(strip(c))


def percent(n: Column, d: Column) -> Column:
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(n / d * 100, 2))


def indent(c: Column) -> Column:
    return F.length(F.regexp_extract(c, r"^[ \t]*", 0))


def json_keys_in_text(c: Column) -> Column:
    """Names that stand quoted before a colon, once each in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\"']([A-Za-z_][A-Za-z0-9_.\-]*)[\"']\s*:"), F.lit(1)))
