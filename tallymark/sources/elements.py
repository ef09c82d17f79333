"""XML elements read in byte ranges.

Spark's own reader gives every file to one task. Here Spark reads text in byte ranges, cut behind each end tag of the
element, so that a file has as many tasks as ranges; each piece is parsed by ``from_xml``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that need no escape in a pattern and stand as they are in a tag.
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
_PROLOG = r"^\uFEFF?\s*<\?xml(?:(?!\?>).)*\?>"


def _pieces(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.option("lineSep", f"</{row_tag}>").text(path)


def _starts(row_tag: str) -> str:
    return f"<{row_tag.replace('.', '[.]')}(?=[\\s/>])"


def can_be_cut(spark: SparkSession, path: str, row_tag: str) -> bool:
    """Whether the end tags of ``row_tag`` cut the files into pieces of one element each.

    So it is if no piece begins two elements (nested or empty ones), no end tag has blanks in it, and nothing stands there in
    which a tag is no tag: comments, character data sections, declarations, other instructions, other encodings than UTF-8.
    One pass over the text, also in byte ranges.
    """
    if not _NAME.fullmatch(row_tag):
        return False
    value = F.col("value")
    body = F.regexp_replace(value, f"(?s){_PROLOG}", "")
    prolog = F.regexp_extract(value, f"(?s){_PROLOG}", 0)
    encoding = F.lower(F.regexp_extract(prolog, "encoding\\s*=\\s*[\"']([^\"']*)", 1))
    odd = (
        (F.regexp_count(value, F.lit(_starts(row_tag))) > 1) | value.rlike(f"</{row_tag.replace('.', '[.]')}\\s+>") | body.rlike(r"<[!?]")
        | ~encoding.isin("", "utf-8", "utf8") | value.contains("\ufffd") | value.contains("\x00"))
    return _pieces(spark, path, row_tag).where(odd).isEmpty()


def read_elements(spark: SparkSession, path: str, row_tag: str, schema: T.StructType, mode: str) -> DataFrame:
    """One row per element, parsed by ``schema``, and the partition columns. The text must be such that ``can_be_cut``."""
    pieces = _pieces(spark, path, row_tag)
    kept = [c for c in pieces.columns if c != "value"]
    own = T.StructType([f for f in schema.fields if f.name not in kept])
    # What comes before the element, and the end of a file, belong to none.
    begun = pieces.where(F.col("value").rlike(_starts(row_tag)))
    element = F.concat(F.regexp_extract("value", f"(?s){_starts(row_tag)}.*", 0), F.lit(f"</{row_tag}>"))
    row: Column = F.from_xml(element, own, {"rowTag": row_tag, "mode": mode})
    parsed = begun.select(row.alias("_row"), *[F.col(f"`{c}`") for c in kept])
    return parsed.select("_row.*", *[F.col(f"`{c}`") for c in kept])
