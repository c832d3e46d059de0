"""Column builders for sequence ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_WORD = "[A-Za-z0-9]+"


def id_words(col: Column) -> Column:
    """The words of an id: its longest runs of ASCII letters and digits, in lower case, in their order. Null for null."""
    joined = F.array_join(F.regexp_extract_all(col, F.lit(ID_WORD), 0), " ")
    return F.filter(F.split(F.lower(joined), " "), lambda w: w != "")


def id_key(col: Column) -> Column:
    """Equal for two ids with the same words, each as often, in whatever order. Null for null, '' without any word."""
    return F.array_join(F.sort_array(id_words(col)), " ")
