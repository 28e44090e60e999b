"""Column functions over texts, paths and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at both ends; Spark's own trim only strips spaces.
_EDGES = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def stem(path: Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def link_key(name: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def link_target(link: Column) -> Column:
    """What stands before an alias or a section."""
    return F.regexp_extract(link, r"^([^|#]*)", 1)


def links(body: Column) -> Column:
    """The insides of all ``[[...]]``, each from its opening to the next closing."""
    return F.regexp_extract_all(body, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))


def field(name: str) -> Column:
    """A field of the header, null if the note lacks it."""
    return F.try_element_at("fields", F.lit(name))


def estimate_tokens(x: Column) -> Column:
    return F.floor(F.octet_length(x) / 3) + 1


def first_chars(x: Column, n: int) -> Column:
    return F.left(x, F.lit(n))


def occurrences(x: Column, word: Column) -> Column:
    """How often a word occurs without overlapping; 0 for an empty word."""
    return F.when(F.length(word) > 0, ((F.length(x) - F.length(F.replace(x, word))) / F.length(word)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def family(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def project(path: Column) -> Column:
    return F.substring_index(path, "/", 2)
