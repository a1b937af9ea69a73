"""Metadata from file names; rewriting of sources; extra columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions.patterns import NamePattern, fill_template
from dawnchorus.functions.text import base_name
from dawnchorus.sizing import write_scratch

# Named destination templates.
SOURCE_TEMPLATES = {
    "baw_original": "{domain}/audio_recordings/{audio_recording_id}/original",
    "ecosounds_original": "https://api.ecosounds.org/audio_recordings/{audio_recording_id}/original",
    "a2o_original": "https://api.acousticsobservatory.org.au/audio_recordings/{audio_recording_id}/original",
}

EXTRA_COLUMNS = ("audio_recording_id",)


@dataclass(frozen=True)
class SourceMap:
    """How a source becomes its published value and which metadata it carries.

    ``static`` values hold for every file; a named group of ``pattern``,
    searched in the base name, overrides them where it matched. ``template``
    may be one of ``SOURCE_TEMPLATES`` or any other text with ``{tokens}``;
    ``template`` and ``extra`` may instead be functions Column -> Column and
    Column -> {name: Column}. A token that nothing defines, or a bad pattern,
    is an error as soon as a plan is made.
    """

    template: str | Callable[[Column], Column] | None = None
    static: Mapping[str, object] = field(default_factory=dict)
    pattern: NamePattern | str | None = None
    extra: Callable[[Column], dict[str, Column]] | None = None

    @property
    def name_pattern(self) -> NamePattern | None:
        return NamePattern.compile(self.pattern) if isinstance(self.pattern, str) else self.pattern

    @property
    def compiled(self) -> bool:
        """Whether all columns are JVM expressions, cheap enough for every window."""
        return self.pattern is None or self.name_pattern.jvm_text is not None

    def metadata(self, source: Column) -> dict[str, Column]:
        """Static values overridden by what the pattern finds; null where neither has one."""
        found = self.name_pattern.extract(base_name(source)) if self.pattern else {}
        merged = {k: F.lit(str(v)) for k, v in self.static.items()}
        for name, value in found.items():
            merged[name] = F.coalesce(value, merged[name]) if name in merged else value
        return merged

    def mapped(self, source: Column) -> Column:
        """The published source; null where a token has no value."""
        if self.template is None:
            return source
        if callable(self.template):
            return self.template(source)
        return fill_template(self.template, self.metadata(source))

    def extra_columns(self, source: Column, names=EXTRA_COLUMNS) -> dict[str, Column]:
        if self.extra is not None:
            return dict(sorted(self.extra(source).items()))
        meta = self.metadata(source)
        return {n: meta[n] for n in sorted(names) if n in meta}


def distinct_sources(df: DataFrame, source: str = "source") -> DataFrame:
    return df.select(F.col(source).alias("source")).distinct()


def map_sources(sources: DataFrame, smap: SourceMap | None, extra=EXTRA_COLUMNS) -> DataFrame:
    """Add ``mapped_source`` and the extra columns to a table with one row per source."""
    smap = smap or SourceMap()
    out = sources.withColumn("mapped_source", smap.mapped(F.col("source")))
    columns = smap.extra_columns(F.col("source"), extra)
    clash = sorted(set(columns) & ({"source", "channel", "offset", "label", "score"} | set(sources.columns)))
    if clash:
        raise ValueError(f"extra columns clash with existing ones: {clash}")
    return out.withColumns(columns) if columns else out


def present_extras(mapped: DataFrame, names) -> list[str]:
    """Extra columns for which at least one source has a value."""
    names = [n for n in names if n in mapped.columns]
    if not names:
        return []
    row = mapped.agg(*[F.max(F.col(n).isNotNull()).alias(n) for n in names]).first()
    return [n for n in sorted(names) if row[n]]


def collisions(mapped: DataFrame) -> DataFrame:
    """Sources that share a published value: (mapped_source, source), all of them.

    Counting is done on distinct pairs with partial aggregation; no list of
    sources is ever built in one row.
    """
    pairs = mapped.select("mapped_source", "source").distinct()
    shared = pairs.groupBy("mapped_source").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.join(shared.select("mapped_source"), "mapped_source", "left_semi")


def collision_summary(mapped: DataFrame) -> DataFrame:
    """Per shared published value: how many sources, the first and the last of them."""
    pairs = mapped.select("mapped_source", "source").distinct()
    return (
        pairs.groupBy("mapped_source")
        .agg(
            F.count(F.lit(1)).alias("n_sources"),
            F.min("source").alias("first_source"),
            F.max("source").alias("last_source"),
        )
        .where("n_sources > 1")
    )


def unresolved(mapped: DataFrame) -> DataFrame:
    """Sources for which a template token had no value."""
    return mapped.where(F.col("mapped_source").isNull()).select("source")


def require_mapped(mapped: DataFrame, smap: SourceMap | None) -> None:
    """Stop on a missing value, a leftover brace or two sources with one value.

    One aggregation by published value counts all three kinds. They are
    reported in that order, with the total, an example and the folder of the
    whole list.
    """
    smap = smap or SourceMap()
    if smap.template is None:
        return
    value = F.col("mapped_source")
    per_value = mapped.groupBy(value).agg(
        F.count(F.lit(1)).alias("n"), F.min("source").alias("low"), F.max("source").alias("high")
    )
    missing = value.isNull()
    braces = value.rlike("[{}]") if isinstance(smap.template, str) else F.lit(False)
    shared = ~missing & (F.col("low") != F.col("high"))
    seen = per_value.agg(
        F.sum(F.when(missing, F.col("n"))).alias("n_missing"), F.min(F.when(missing, F.col("low"))).alias("missing"),
        F.count_if(braces).alias("n_braces"), F.min(F.when(braces, value)).alias("braces"),
        F.count_if(shared).alias("n_shared"), F.min(F.when(shared, value)).alias("shared"),
    ).first()
    if seen["n_missing"]:
        folder = write_scratch(unresolved(mapped))
        raise ValueError(f"missing token value for {seen['n_missing']} sources, e.g. {seen['missing']!r}; all in {folder}")
    if seen["n_braces"]:
        folder = write_scratch(mapped.where(braces).select("source", "mapped_source"))
        raise ValueError(
            f"unsupported brace syntax in {seen['n_braces']} rendered sources, e.g. {seen['braces']!r}; all in {folder}"
        )
    if seen["n_shared"]:
        folder = write_scratch(collisions(mapped))
        raise ValueError(
            f"source map collision: {seen['n_shared']} values have several sources, e.g. {seen['shared']!r}; all in {folder}"
        )


def require_pattern_for_many(n_inputs: int, smap: SourceMap | None) -> None:
    """A template without a pattern would give every file the same source."""
    if smap and isinstance(smap.template, str) and smap.pattern is None and n_inputs > 1:
        raise ValueError(
            "a source template without a pattern can't be used with several input files: "
            "every file would map to the same source"
        )
