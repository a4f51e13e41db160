"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(text: Column) -> Column:
    """White space off both ends, in the sense of Unicode."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^ \n]+)"), 1)


def token_len(text: Column) -> Column:
    """The number of longest runs of characters other than space and line feed; 0 for null."""
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("long")


def strict_float(text: Column) -> Column:
    """A finite decimal number and nothing else: no suffix, no hexadecimal, no NaN or infinity, no digit groups."""
    t = strip(text)
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double"))


def after_marker(text: Column, marker: str = "ANSWER:") -> Column:
    """The segment between the first and the second marker, stripped; null without a marker."""
    return strip(F.try_element_at(F.split(text, marker), F.lit(2)))


def id_key(custom_id: Column) -> Column:
    """custom_id apart from its spelling: percent signs decoded, lower case, one mark for any run of others."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(custom_id, "%(?:23|20|5[fF])", "#")), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def csv_ids(text: Column) -> Column:
    return F.transform(F.split(text, ","), strip)


def join_keywords(text: Column, keywords: list[str]) -> Column:
    """Punctuation to spaces; every keyword in the lower-cased text has its words tied with an underscore."""
    out = F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))
    for k in keywords:
        out = F.replace(F.lower(out), F.lit(k), F.lit(k.replace(" ", "_")))
    return out


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    """0 where the deviation is 0 or unknown."""
    return F.coalesce(F.try_divide(x - mean, F.nullif(sd, F.lit(0.0))), F.lit(0.0))
