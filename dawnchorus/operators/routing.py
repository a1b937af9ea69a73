"""Destinations of output rows, rendered from path templates."""

from __future__ import annotations

import re
import warnings
from pathlib import PureWindowsPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.checks import require_none
from dawnchorus.functions.patterns import fill_template
from dawnchorus.functions.text import clean_path, file_stem, parent_path

# Layout presets, the tokens each output allows, the analysis names.
LAYOUTS = {
    "nested_filestem": "{parents}/{filestem}{ext}",
    "flat_filestem": "{filestem}{ext}",
    "nested": "{parents}/{analysis}{ext}",
    "flat": "{analysis}{ext}",
}
DEFAULT_LAYOUT = "flat"
TOKENS = {
    "embeddings": {"parents", "filestem", "ext", "embeddings_table_format", "analysis"},
    "recognizer": {"classifier_name", "parents", "filestem", "ext", "analysis"},
    "classify": {"parents", "filestem", "ext", "analysis"},
}
ANALYSIS = {
    "embeddings": "embeddings",
    "recognizer": "recognizer_results",
    "classify": "classify_results",
}

_ANY_TOKEN = re.compile(r"\{([^{}]+)\}")
_PIECE = re.compile(r"\{([^{}]+)\}|[^{}]+|[{}]")


def check_template(template: str, kind: str) -> str:
    """The trimmed template; unknown tokens and unsafe paths are errors.

    The template is cut once into tokens and literal text. With a plain name
    in place of every token it must be a relative path that stays below its root.
    """
    allowed = TOKENS.get(kind)
    if allowed is None:
        raise ValueError(f"unknown output kind {kind!r}; known: {sorted(TOKENS)}")
    text = template.strip() if isinstance(template, str) else ""
    if not text:
        raise ValueError("path template can't be empty and must be a string")
    pieces = list(_PIECE.finditer(text))
    strange = sorted({p[1] for p in pieces if p[1]} - allowed)
    if strange:
        raise ValueError(f"unknown path tokens {strange}; known: {sorted(allowed)}")
    path = PureWindowsPath("".join("name" if p[1] else p[0] for p in pieces))  # takes both kinds of slash
    if path.root:
        raise ValueError("path template must be relative")
    if ".." in path.parts:
        raise ValueError("path template can't contain '..'")
    return text


def resolve_layout(template: str | None = None, layout: str | None = None) -> str:
    if template is not None and layout is not None:
        raise ValueError("give a path template or a layout, not both")
    if template is not None:
        return template
    if (layout or DEFAULT_LAYOUT) not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; known: {sorted(LAYOUTS)}")
    return LAYOUTS[layout or DEFAULT_LAYOUT]


def destination(
    source: Column,
    template: str,
    kind: str,
    filetype: str,
    table_format: str | None = None,
    classifier_name: Column | None = None,
) -> Column:
    """Relative output path of a source as a Column.

    Token values are joined once and not scanned again. A path without the
    output's extension gets it appended.
    """
    template = check_template(template, kind)
    ext = "." + filetype.lstrip(".")
    values = {
        "parents": parent_path(source),
        "filestem": file_stem(source),
        "ext": F.lit(ext),
        "analysis": F.lit(ANALYSIS[kind]),
    }
    if table_format is not None:
        values["embeddings_table_format"] = F.lit(table_format)
    if classifier_name is not None:
        values["classifier_name"] = classifier_name
    _warn_on_fixed_suffix(template, ext)
    raw = fill_template(template, values, _ANY_TOKEN)
    slashed = F.replace(raw, F.lit("\\"), F.lit("/"))
    has_ext = F.endswith(slashed, F.lit(ext)) & ~F.endswith(slashed, F.lit("/" + ext)) & (slashed != ext)
    # A trailing separator hides an extension before it.
    trailing = F.endswith(slashed, F.lit("/")) | F.endswith(slashed, F.lit("/."))
    bare = F.regexp_replace(slashed, rf"(?<=[^/]){re.escape(ext)}(?:/+\.?)*\z", "")
    full = F.when(has_ext, slashed).otherwise(F.concat(F.when(trailing, bare).otherwise(slashed), F.lit(ext)))
    return clean_path(full)


def _warn_on_fixed_suffix(template: str, ext: str) -> None:
    last = template.replace("\\", "/").rsplit("/", 1)[-1]
    found = re.search(r"[^{}](\.[^.{}]+)$", last)
    if found and found.group(1) != ext:
        warnings.warn(
            f"path template ends in {found.group(1)!r} but the output is {ext!r}; {ext!r} is appended",
            UserWarning,
            stacklevel=3,
        )


def unsafe(paths: DataFrame, column: str) -> DataFrame:
    """Absolute paths and paths with a ``..`` component."""
    return paths.where(F.col(column).rlike(r"^/|(^|/)\.\.(/|$)")).select(column)


def require_safe(paths: DataFrame, column: str = "source") -> None:
    require_none(unsafe(paths, column), "paths must be relative and free of '..'")


def route_counts(rows_per_source: DataFrame) -> DataFrame:
    """Rows and sources per destination, from one row per destination and source (``n_rows``)."""
    return rows_per_source.groupBy("dest").agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_sources")
    )
