"""Quality rules by distribution divergence: how far a text's characters and common words stray from its language.

Each language has a reference, however few its words, counted over all its texts: shares of character
classes, and shares of its ``COMMON`` commonest words (of ``LONGEST`` letters at
most, as common words are; upper and lower case differ) and of all others. A
text is compared with the reference of its language (of no known language:
with the nearest one) by Jensen-Shannon distance, if it is long enough for
its histogram to mean something. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.common import drop_stored, stored

COMMON = 30  # common words of a reference
LONGEST = 5  # letters of a common word
LEAST_WORDS = 50  # guard of the word histogram and of the character histogram
MOST_CHARACTER_DISTANCE = 0.3
MOST_WORD_DISTANCE = 0.45
REPEAT_PERCENT = 50
BLANK = r"[\t-\r ]+"
PLAIN = r"[\p{Ll}\t-\r ]+"
OTHERS = {"upper": r"\p{Lu}+", "digit": r"[0-9]+", "mark": r"[\p{P}\p{S}]+"}


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def _without(text: Column, pattern: str) -> Column:
    """How many characters a pattern takes from the text."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _measured(rows: DataFrame) -> DataFrame:
    """Adds the base measures and the character histogram to rows with text and lang."""
    words, text = F.col("words"), F.col("text")
    out = rows.withColumn("words", _words(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\t-\r ]"))
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "lines": lines, "odd": F.regexp_replace(text, PLAIN, ""),
            "hashes": F.when(F.size(words) > 2, F.transform(words, lambda w: F.xxhash64(w))),
        }
    )
    one, n = F.col("hashes"), F.size("hashes")
    runs = F.arrays_zip(F.slice(one, 1, n - 2), F.slice(one, 2, n - 2), F.slice(one, 3, n - 2))
    out = out.withColumns(
        {
            "n_symbols": _without(F.col("odd"), r"[#*$%&|<>]+").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            **{c: _without(F.col("odd"), p) for c, p in OTHERS.items()},
            "windows": F.transform(runs, lambda r: F.xxhash64(r)),
        }
    )
    windows = F.col("windows")
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    out = out.withColumns(
        {
            "in_order": F.when(
                repeated, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            ),
            "counts": F.array(
                F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("mark"), *OTHERS
            ).cast("array<double>"),
        }
    )
    order = F.col("in_order")
    twice = F.filter(
        F.transform(
            order,
            lambda w, j: F.when(
                F.get(order, j - 1)["h"].eqNullSafe(w["h"]) | F.get(order, j + 1)["h"].eqNullSafe(w["h"]),
                w["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    out = out.withColumn("twice", F.sort_array(twice))
    at = F.col("twice")
    covered = F.aggregate(
        F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3)))),
        F.lit(0), lambda a, b: a + b,
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "lines", "odd", "hashes", "windows", "in_order", "twice", *OTHERS
    )


def _term(p: Column, q: Column) -> Column:
    """Summand of twice the Jensen-Shannon divergence, in bits."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    return part(p, q) + part(q, p)


def _distance(p: Column, q: Column) -> Column:
    total = F.aggregate(F.zip_with(p, q, _term), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / total)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per language that has a word: lang, words (its common ones), shares (theirs, then all others'), classes (shares).

    Counted over all texts, and written to the shared folder: COMMON words and four class shares a language.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).where("lang IS NOT NULL")
    odd = rows.select("lang", F.regexp_replace("text", PLAIN, "").alias("odd"))
    classes = odd.select("lang", *[_without(F.col("odd"), p).alias(c) for c, p in OTHERS.items()])
    classes = classes.groupBy("lang").agg(*[F.sum(c).alias(c) for c in OTHERS])
    words = rows.select("lang", F.explode(_words(F.col("text"))).alias("word"))
    short = F.when(F.length("word") <= LONGEST, F.col("word"))
    counted = stored(
        words.groupBy("lang", short.alias("word")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars")
        ),
        "words",
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("chars").alias("chars"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = counted.where("word IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= COMMON)
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"), F.sum("n").alias("common"))
    told = totals.join(F.broadcast(classes), "lang").join(F.broadcast(top), "lang", "left")
    shares = F.coalesce(F.transform("top.n", lambda n: n / F.col("total")), F.array().cast("array<double>"))
    plain = F.col("chars") - F.col("upper") - F.col("digit") - F.col("mark")
    out = stored(
        told.select(
            "lang", F.coalesce(F.col("top.word"), F.array().cast("array<string>")).alias("words"),
            F.concat(shares, F.array((F.col("total") - F.coalesce(F.col("common"), F.lit(0))) / F.col("total"))).alias("shares"),
            F.array(*[c / F.col("chars") for c in (plain, *map(F.col, OTHERS))]).alias("classes"),
        ).coalesce(1),
        "references",
    )
    drop_stored(counted)
    return out


def _against(ref: Column) -> Column:
    """Distances of a row's characters and words from those of a reference."""
    signs = F.array(*[F.lit(chr(0x4E00 + i)) for i in range(COMMON)])  # one for each common word
    total, size = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    listed, mine = ref["words"], F.slice(signs, F.lit(1), F.size(ref["words"]))
    known = F.filter("short", lambda w: F.array_contains(listed, w))
    signed = F.array_join(F.transform(known, lambda w: F.get(signs, (F.array_position(listed, w) - 1).cast("int"))), "")

    def shares(s: Column) -> Column:
        counts = F.transform(mine, lambda x: (F.length(s) - F.length(F.replace(s, x, F.lit("")))) / total)
        return F.concat(counts, F.array((total - F.length(s)) / total))

    return F.struct(
        _distance(_shares(F.col("counts"), size), ref["classes"]).alias("chars"),
        _with(_with(signed, shares), lambda own: _distance(own, ref["shares"])).alias("words"),
    )


def judged(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds measures, distances and ``kept`` to rows with text and lang."""
    named = refs.select(F.col("lang").alias("ref_lang"), F.struct("words", "shares", "classes").alias("own"))
    every = refs.agg(F.collect_list(F.struct("words", "shares", "classes")).alias("every"))
    out = _measured(rows).withColumn("short", F.filter("words", lambda w: F.length(w) <= LONGEST))
    out = out.join(F.broadcast(named), F.col("lang") == F.col("ref_lang"), "left").crossJoin(F.broadcast(every))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    near = F.transform("every", lambda r: _with(_against(r), lambda d: F.struct((d["chars"] + d["words"]).alias("sum"), d.alias("d"))))
    chosen = F.when(F.col("own").isNotNull(), _against(F.col("own"))).otherwise(F.array_min(near)["d"])
    long = F.col("n_words") >= LEAST_WORDS
    out = out.withColumn("near", F.when(long, chosen))
    out = out.withColumns({"char_distance": F.col("near.chars"), "word_distance": F.col("near.words")})
    strays = long & ((F.col("char_distance") > MOST_CHARACTER_DISTANCE) | (F.col("word_distance") > MOST_WORD_DISTANCE))
    return out.withColumn("kept", ~failed & ~F.coalesce(strays, F.lit(False))).drop("words", "counts", "short", "ref_lang", "own", "every", "near")


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, the base measures, base_failed, char_distance, word_distance, kept.

    Null texts are empty: no words, so they fail. Distances are null below
    LEAST_WORDS words or where no row has a language; ``kept`` then follows the base
    rules alone. A null language is compared with the nearest reference. Repeated rows get a row each; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    )
    return judged(rows, references(docs, text_col=text_col, lang_col=lang_col)).drop("text", "lang")


def good_documents(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs``, all columns, that the rules keep; nothing of a text is shuffled."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
    )
    flagged = judged(rows, references(docs, text_col=text_col, lang_col=lang_col))
    # a generator and not a filter on the verdict: the optimizer would repeat the whole expression below every projection
    kept = flagged.select(F.explode_outer(F.when(F.col("kept"), F.array("doc"))).alias("doc")).where("doc IS NOT NULL")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
