"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share a budget of words by weight, none above a multiple of
its own size. Curriculum: each source has a schedule, its relative weight over
training time from 0 to 1, linear between knots. The integral of the schedule
is the source's cumulative demand for words; a document copy stands at the
time at which that demand reaches its place in the source's shuffled words.
Documents are range-sorted by that position. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.common import stored
from dawnchorus.llm.quality_rules import BLANK

WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
#: Knots (time, relative weight) by rank of the source, repeating: rising, steady, falling, peaking.
SCHEDULES = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),
)
BUDGET_PERCENT, MOST_TIMES = 150, 2
ROW = "row of the mix"
BINS = 4096  # parts of a source in which running sums are taken apart


def _n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK))).cast("long")


def _repeating(values: list[Column], rank: Column) -> Column:
    return F.element_at(F.array(*values), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, most_times: int = MOST_TIMES
) -> DataFrame:
    """Targets of sources from (source, source_size): adds rank, weight, target.

    Ranks follow code points, null last. A target is ``weight * level``, at most
    ``most_times`` the source's size; ``level`` spends the whole budget: it is
    the largest of the levels that follow from stopping the first sources in
    the order of size to weight. Works on one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name)
    ranked = sizes.withColumn("rank", rank).withColumn("weight", _repeating([F.lit(w) for w in weights], F.col("rank")))
    cap = F.col("source_size") * most_times
    by_ratio = everything.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * budget_percent
    level = (budget - before * 100) / (open_weight * 100)
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level"))).drop("level")


def _demand(schedule: tuple) -> list[tuple[float, float, float]]:
    """(time, weight, integral so far) at each knot."""
    out, total = [], 0.0
    for k, (t, w) in enumerate(schedule):
        if k:
            t0, w0 = schedule[k - 1]
            total += (t - t0) * (w + w0) / 2
        out.append((t, w, total))
    return out


def _time_of(share: Column, schedule: tuple) -> Column:
    """The time at which a share of the schedule's whole demand is reached, by solving the segment's parabola."""
    knots = _demand(schedule)
    total = knots[-1][2]
    result = F.lit(knots[-1][0])
    for (t0, w0, i0), (t1, w1, i1) in reversed(list(zip(knots, knots[1:], strict=False))):
        slope = (w1 - w0) / (t1 - t0)
        area = F.greatest(share * total - i0, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * area, F.lit(0.0)))
        time = F.when(area > 0, F.least(t0 + 2 * area / (w0 + root), F.lit(t1))).otherwise(F.lit(t0))
        result = F.when(share * total < i1, time).otherwise(result)
    return result


def _timed(schedule: tuple):
    return lambda share: _time_of(share, schedule)


def _words_of(copy: Column, size: Column) -> Column:
    return F.when(copy < F.col("rounds"), size).otherwise(F.col("part"))


def _share_of(copy: Column, size: Column, total: Column) -> Column:
    return (copy * total + F.col("before") + _words_of(copy, size) / 2) / F.col("target")


def mixture(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, budget_percent: int = BUDGET_PERCENT,
    most_times: int = MOST_TIMES, seed: int = 7, row_key: str | None = None,
) -> DataFrame:
    """Per row of ``docs``, in training order: doc_id, source, size, source_size, target, taken, positions.

    With ``row_key``, a column of ``docs``, that column under its name comes last.

    ``size`` is the number of words. Within a source documents are ordered by
    a digest of seed, id and text; the source's words are taken in that order,
    as often as its target holds them, the last document in part, so that the
    words taken differ from the target by less than one. ``positions`` has the
    training time (0 to 1) of each copy, the cut one last. Null and empty texts have size 0
    and no position, and stand last. Null is a source of its own.
    Repeated rows get a row each. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), _n_words(text).alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), ident, F.md5(text))).alias("turn"),
            *([F.col(f"`{row_key}`").alias(ROW)] if row_key else []),
        ).withColumn("bin", (F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * BINS / F.lit(1 << 32)).cast("int")),
        "sizes",
    )
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    keyed = sized.withColumn("key", key)
    bins = keyed.groupBy("key", "source", "bin").agg(F.sum("size").alias("bin_size"))
    bins = stored(bins, "bins")
    targets = source_targets(
        bins.groupBy("key", "source").agg(F.sum("bin_size").alias("source_size")),
        weights=weights, budget_percent=budget_percent, most_times=most_times,
    )
    earlier = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
    starts = starts.select("key", "bin", "bin_start").join(targets.drop("source"), "key")
    inside = Window.partitionBy("key", "bin").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["key", "bin"])
    total, size = F.col("source_size"), F.col("size")
    rounds = F.when(total > 0, F.floor(F.col("target") / total)).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("before", F.col("before") + F.col("bin_start")).withColumn("rounds", rounds)
    rest = F.floor(F.col("target") - F.col("rounds") * total + 0.5).cast("long")
    part = F.greatest(F.least(rest - F.col("before"), size), F.lit(0))
    placed = placed.withColumn("part", part).withColumn("taken", F.col("rounds") * size + F.col("part"))
    # each copy stands at the middle of the words it gives
    at = [F.lit(c) for c in range(most_times + 1)]
    shares = F.array(*[F.when(c <= F.col("rounds"), F.when(_words_of(c, size) > 0, _share_of(c, size, total))) for c in at])
    placed = placed.withColumn("shares", F.filter(shares, lambda s: s.isNotNull()))
    turn = (F.col("rank") - 1) % len(schedules)
    positions = F.transform("shares", _timed(schedules[0]))
    for k, schedule in enumerate(schedules[1:], 1):
        positions = F.when(turn == k, F.transform("shares", _timed(schedule))).otherwise(positions)
    placed = placed.withColumn("positions", positions)
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    out = placed.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", first.alias("first"), "turn")
    if row_key:  # the caller joins and sorts
        return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", F.col(ROW).alias(row_key))
    return out.repartitionByRange("first", "turn").sortWithinPartitions("first", "turn").drop("first", "turn")


def mixed_documents(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, taken and positions, in training order.

    The documents are written once with a key per row, by which the mix of the narrow
    columns is joined back: ids may be null or repeat. Documents are then dealt out by
    the time of their first copy, which the mix spreads evenly over words; those
    that are not taken stand last. A column of ``docs`` that has the name of one of
    the mix's keeps it, the mix's is then called ``mix_`` and its name.
    """
    rows = stored(docs.withColumn(ROW, F.expr("uuid()")), "mixed")
    mixed = mixture(rows, text_col=text_col, row_key=ROW, **options)
    names = {n: f"mix_{n}" if n in docs.columns else n for n in ("size", "source_size", "target", "taken", "positions")}
    mixed = mixed.select(F.col(ROW).alias("mixed row"), *[F.col(n).alias(f"mixed {n}") for n in names])
    joined = rows.join(mixed, F.col(ROW) == F.col("mixed row")).drop("mixed row")
    first = F.get("mixed positions", F.lit(0))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    late = F.pmod(F.xxhash64(ROW), F.lit(parts))
    place = F.when(first.isNull(), late + parts).otherwise(F.least(F.floor(first * parts), F.lit(parts - 1))).cast("int")
    placed = joined.withColumn("mixed place", place).repartitionById(2 * parts, F.col("mixed place"))
    ordered = placed.withColumn("mixed first", F.coalesce(first, F.lit(2.0))).sortWithinPartitions("mixed first", ROW)
    return ordered.drop("mixed place", "mixed first", ROW).withColumnsRenamed({f"mixed {n}": to for n, to in names.items()})


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy of a document, range-sorted by training position: doc_id, source, copy, position."""
    rows = mixed.select("doc_id", "source", F.posexplode("positions").alias("copy", "position"))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
