"""String and path columns with the semantics of Python text handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes.
PYTHON_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)

ITEM_SEPARATORS = "[\n,]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PYTHON_SPACE))


def split_items(c: Column) -> Column:
    """Comma/newline separated text to its stripped, non-empty items."""
    return F.filter(F.transform(F.split(c, ITEM_SEPARATORS), strip), lambda x: x != "")


def normalized_items(c: Column) -> Column:
    """Items lower-cased, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(split_items(c), F.lower)))


def candidate_labels(c: Column) -> Column:
    """The whole entry, then what stands left and right of its first underscore."""
    whole = strip(c)
    cut = F.locate("_", whole)
    halves = F.when(
        cut > 0,
        F.array(
            strip(F.substring_index(whole, "_", 1)),
            strip(F.substring(whole, cut + 1, F.char_length(whole))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(whole), halves), lambda x: x != ""))


def clean_path(c: Column) -> Column:
    """A relative path without empty and ``.`` components.

    Most paths are clean, which two searches for literals show; only the others
    meet the pattern.
    """
    framed = F.concat(F.lit("/"), c, F.lit("/"))
    unclean = F.contains(framed, F.lit("//")) | F.contains(framed, F.lit("/./"))
    cleaned = F.rtrim(F.regexp_replace(c, r"(^|/)(?:\.?/)+(?:\.\z)?|(?:/\.?|^\.)\z", "$1"), F.lit("/"))
    return F.when(unclean, cleaned).otherwise(c)


def path_depth(c: Column) -> Column:
    """Number of components."""
    return F.regexp_count(clean_path(c), F.lit("[^/]+"))


def base_name(c: Column) -> Column:
    return F.substring_index(clean_path(c), "/", -1)


def first_folder(c: Column) -> Column:
    """First component of a path that has a folder, else null."""
    return F.nullif(F.regexp_extract(clean_path(c), "^([^/]+)/", 1), F.lit(""))


def parent_path(c: Column) -> Column:
    path = clean_path(c)
    return F.left(path, F.char_length(path) - F.char_length(F.substring_index(path, "/", -1)) - 1)


def file_stem(c: Column) -> Column:
    """Base name without its last suffix; a leading dot belongs to the stem."""
    return F.regexp_replace(base_name(c), r"(?s)(?<=.)\.[^.]+\z", "")


def file_suffix(c: Column) -> Column:
    """Last suffix with its dot, or an empty string."""
    return F.regexp_extract(base_name(c), r"(?s).(\.[^.]+)\z", 1)


def window_key(source: Column, offset_s: Column) -> Column:
    """``source_offset`` with the offset printed like ``5.0``."""
    return F.concat_ws("_", source, offset_s.cast("double").cast("string"))


def casefold(c: Column) -> Column:
    """Full Unicode case folding, which neither ``lower`` nor a collation offers.

    Runs in Arrow batches; meant for distinct labels, not for fact rows.
    """

    @F.pandas_udf("string")
    def fold(s):
        return s.map(lambda x: None if x is None else x.casefold())

    return fold(c)
