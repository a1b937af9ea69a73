"""Label lists: splitting, translation into a target taxonomy, validation.

Lists are tables with an explicit order column, so that "first" and "last"
don't depend on how rows are spread over tasks. Work is done on distinct
labels; facts are joined to the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.checks import SHOWN
from dawnchorus.functions.text import candidate_labels, casefold, normalized_items, split_items, strip
from dawnchorus.sizing import broadcast_if_small, written


def split_list(items: DataFrame, text: str = "raw", order: str = "item_ord") -> DataFrame:
    """Comma/newline lists to single values, each at its first position.

    Result: value, item_ord, pos. Case is kept. Sort by (item_ord, pos) for the
    list order.
    """
    values = items.select(F.col(order).alias("item_ord"), F.posexplode(split_items(F.col(text))).alias("pos", "value"))
    first = F.min(F.struct("item_ord", "pos")).alias("at")
    return values.groupBy("value").agg(first).select("value", "at.item_ord", "at.pos")


def normalize_lists(items: DataFrame, text: str = "raw", into: str = "items") -> DataFrame:
    """Each list lower-cased, distinct and sorted."""
    return items.withColumn(into, normalized_items(F.col(text)))


def candidates(items: DataFrame, text: str = "raw") -> DataFrame:
    """Distinct entries to (raw, cand_ord, candidate) rows."""
    raw = items.select(F.col(text).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    return raw.select("raw", F.posexplode(candidate_labels(F.col("raw"))).alias("cand_ord", "candidate"))


def translate_code_first(
    items: DataFrame, codes: DataFrame, names_to_codes: DataFrame, text: str = "raw"
) -> DataFrame:
    """Entries to species codes: (raw, label), label null where nothing matched.

    Every candidate is tried as a code before any is tried as a scientific
    name (lower-cased source of the mapping).

    ``codes``: label. ``names_to_codes``: src, dst, ord.
    """
    cand = candidates(items, text)
    direct = cand.join(codes.select(F.col("label").alias("candidate")).distinct(), "candidate", "left_semi")
    direct = direct.select("raw", F.lit(0).alias("rule"), "cand_ord", F.col("candidate").alias("label"))
    pairs = _last_pair(names_to_codes)
    named = (
        cand.withColumn("src", F.lower("candidate"))
        .join(pairs, "src")
        .select("raw", F.lit(1).alias("rule"), "cand_ord", F.col("dst").alias("label"))
    )
    hits = direct.unionByName(named)
    best = hits.groupBy("raw").agg(F.min_by("label", F.struct("rule", "cand_ord")).alias("label"))
    return _with_misses(items, best, text)


def translate_name_first(
    items: DataFrame,
    valid: DataFrame,
    mappings: DataFrame,
    target_namespace: str | None = None,
    text: str = "raw",
) -> DataFrame:
    """Entries to valid names: (raw, label), label null where nothing matched.

    All rules are tried on one candidate before the next candidate: exact,
    lower-cased, then each mapping in name order (candidate, else its lower
    case) whose target is valid exactly or lower-cased.

    ``valid``: label, ord. ``mappings``: mapping, target_namespace, ord, src, dst.
    """
    cand = candidates(items, text)
    exact = valid.select("label").distinct()
    by_lower = valid.groupBy(F.lower("label").alias("low")).agg(F.max_by("label", "ord").alias("label"))
    if target_namespace is not None:
        mappings = mappings.where(F.col("target_namespace") == target_namespace)
    pairs = mappings.groupBy("mapping", "src").agg(F.max_by("dst", "ord").alias("dst"))

    rule0 = cand.join(exact.withColumnRenamed("label", "candidate"), "candidate", "left_semi").select(
        "raw", "cand_ord", F.lit(0).alias("rule"), F.lit("").alias("mapping"), F.col("candidate").alias("label")
    )
    rule1 = (
        cand.withColumn("low", F.lower("candidate"))
        .join(by_lower, "low")
        .select("raw", "cand_ord", F.lit(1).alias("rule"), F.lit("").alias("mapping"), "label")
    )
    # A mapping is asked for the candidate and, only if that is unknown to it, for the lower case.
    forms = cand.select(
        "raw", "cand_ord", F.posexplode(F.array("candidate", F.lower("candidate"))).alias("form", "src")
    )
    mapped = (
        forms.join(pairs, "src")
        .groupBy("raw", "cand_ord", "mapping")
        .agg(F.min_by("dst", "form").alias("dst"))
    )
    accepted = (
        mapped.join(exact.select(F.col("label").alias("dst"), F.col("label").alias("__exact")), "dst", "left")
        .withColumn("low", F.lower("dst"))
        .join(by_lower.select("low", F.col("label").alias("__folded")), "low", "left")
        .withColumn("label", F.coalesce("__exact", "__folded"))
        .where(F.col("label").isNotNull())
        .select("raw", "cand_ord", F.lit(2).alias("rule"), "mapping", "label")
    )
    hits = rule0.unionByName(rule1).unionByName(accepted)
    rank = F.struct("cand_ord", "rule", "mapping")
    best = hits.groupBy("raw").agg(F.min_by("label", rank).alias("label"))
    return _with_misses(items, best, text)


def _last_pair(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src").agg(F.max_by("dst", "ord").alias("dst"))


def _with_misses(items: DataFrame, best: DataFrame, text: str) -> DataFrame:
    raw = items.select(F.col(text).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    return raw.join(best, "raw", "left")


def translated_list(
    items: DataFrame, translation: DataFrame, text: str = "raw", order: str = "item_ord"
) -> DataFrame:
    """Translated labels, each once, at its first position: (label, item_ord)."""
    first = items.groupBy(F.col(text).alias("raw")).agg(F.min(order).alias("item_ord"))
    hits = translation.where(F.col("label").isNotNull())
    return first.join(hits, "raw").groupBy("label").agg(F.min("item_ord").alias("item_ord"))


def unmatched(items: DataFrame, translation: DataFrame, text: str = "raw", order: str = "item_ord") -> DataFrame:
    """List entries without a translation, in list order by ``item_ord``."""
    hits = translation.where(F.col("label").isNotNull()).select(F.col("raw").alias(text))
    return items.select(order, text).join(hits, text, "left_anti")


def require_any(translation: DataFrame, label_space: str) -> None:
    """A list in which nothing matches is an error; an empty list is not."""
    total, hits = translation.agg(F.count(F.lit(1)), F.count("label")).first()
    if total and not hits:
        raise ValueError(f"no list entry matches the label space {label_space!r}")


def canonicalize(
    items: DataFrame, allowed: DataFrame, text: str = "raw", order: str = "item_ord"
) -> DataFrame:
    """Entries matched to allowed names ignoring case and outer blanks.

    One row per distinct entry: raw, item_ord (first position), label (null if
    unknown). Of allowed names equal but for case the last one counts.
    ``allowed``: label, ord.
    """
    names = (
        allowed.withColumn("label", strip(F.col("label")))
        .where("label <> ''")
        .groupBy(casefold(F.col("label")).alias("__fold"))
        .agg(F.max_by("label", "ord").alias("label"))
    )
    entries = items.groupBy(F.col(text).alias("raw")).agg(F.min(order).alias("item_ord"))
    entries = entries.withColumn("__fold", casefold(strip(F.col("raw"))))
    return entries.join(names, "__fold", "left").select("raw", "item_ord", "label")


def canonical_list(matched: DataFrame) -> DataFrame:
    """Canonical names, each once, in first-seen order: (label, item_ord)."""
    return (
        matched.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.min("item_ord").alias("item_ord"))
    )


def require_all_known(matched: DataFrame, label_space: str) -> None:
    bad = matched.where(F.col("label").isNull())
    rows = bad.orderBy("item_ord").select(strip(F.col("raw")).alias("raw")).limit(SHOWN).collect()
    if rows:
        shown = ", ".join(repr(r["raw"]) for r in rows)
        raise ValueError(f"list holds species unknown to the label space {label_space!r}: {shown}")


def harmonize(
    facts: DataFrame, column: str, translation: DataFrame, into: str = "label"
) -> DataFrame:
    """Add the translated label to any table with a label column.

    The translation of the distinct labels is written once; if it is small, and
    only then, the facts meet it without a shuffle.
    """
    found = written(translation.select(F.col("raw").alias(column), F.col("label").alias(into)))
    return facts.join(broadcast_if_small(found), column, "left")
