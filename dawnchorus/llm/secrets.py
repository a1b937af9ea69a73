"""Secrets by ownership frequency: who else holds a candidate tells copied examples from live credentials.

Candidates are found in whole texts: assignments, access keys and long hex
runs (the base kinds), and opaque tokens. Their hashes are counted by distinct
repositories and owners over the whole corpus. A candidate held by
``copied_owners`` owners or more, or in ``copied_repositories`` repositories or
more whoever owns them, is a copied example; any other that looks random is
live. Opaque tokens become spans of kind ``owned`` only when live. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import join_same, stored

# Fixed patterns; letters of the keywords in either case.
ASSIGN = (
    r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your|xxxx|1234567)"
KINDS = ("assign", "access", "hex", "owned")
CHUNK = 256
LEAST_VALUE = 6
LEAST_CHARACTERS = 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(values: Column) -> Column:
    """An array in pieces of ``CHUNK``: what grows by a piece at a time is copied once per piece, not once per element."""
    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))


def _placed(text: Column, pattern: str, group: int, kind: str) -> Column:
    """Matches with their places in code points, found between the pieces that the pattern splits the text into."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    matches = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.split(text, pattern).alias("before"))
    span = "struct<start:int,rank:int,end:int,value:string>"
    empty = F.array().cast(f"array<{span}>")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["before"])
        end = start + F.length(m["whole"])
        one = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), m["value"].alias("value")
        )
        return F.when(m["whole"].isNull(), state).otherwise(
            F.struct(end.alias("at"), F.concat(state["found"], F.array(one.cast(span))).alias("found"))
        )

    def moved(part: Column, by: Column) -> Column:
        return F.transform(
            part["found"], lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        )

    def joined(parts: Column) -> Column:
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda held, p: F.concat(held, F.array(F.element_at(held, -1) + p["at"])))
        return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), moved)).cast(f"array<{span}>")

    first = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    found = _let(matches, lambda ms: _let(F.transform(_chunks(ms), lambda c: F.aggregate(c, first, step)), joined))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _below(values: Column, condition) -> Column:
    """How many leading elements of a sorted array meet the condition, by halving."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        below = F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(condition(F.get(values, middle)), above).otherwise(below)

    whole = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    steps = F.array_repeat(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(steps, whole, halved, lambda s: s["low"])


def _meets(span: Column, spans: Column) -> Column:
    """Whether a span overlaps any of sorted spans that don't overlap one another."""
    before = F.get(spans, _below(spans, lambda b: b["start"] < span["end"]) - 1)
    return F.coalesce(before["end"] > span["start"], F.lit(False))


def _looks_random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS) & ~value.rlike(PLACEHOLDER)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(
        F.sort_array(spans),
        lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def _values(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["value"])


def secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None,
    owner: Column | None = None, copied_owners: int = 3, copied_repositories: int = 4,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, base and added spans, and counts of live and copied values.

    Columns: n_assign, n_access, n_hex, base (array of spans), added (array of
    spans), base_list, span_list, n_live, n_copied, holders (array of hash,
    n_owners and n_repositories of each distinct value). A span has start, rank of
    its kind, end (code points, exclusive) and value. ``repository`` and
    ``owner`` are columns of ``docs``, by default ``source``; null counts as one
    repository or owner of its own, and repositories of the same name under two
    owners are two. Null and empty texts have no spans.
    Repeated rows get a row each. An empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("source") if repository is None else repository
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
    )
    text = F.col("text")
    placed = texts.select(
        "doc_id", "owner", "repository", F.xxhash64("text").alias("text_hash"),
        F.filter(_placed(text, ASSIGN, 2, "assign"), lambda s: F.length(s["value"]) >= LEAST_VALUE).alias("assign"),
        _placed(text, ACCESS, 0, "access").alias("access"), _placed(text, HEX, 0, "hex").alias("hex"),
        _placed(text, OPAQUE, 0, "owned").alias("opaque"),
    )
    mixed = r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
    found = F.struct(*[F.col(k) for k in ("assign", "access", "hex", "opaque")])
    outside = _let(
        found,
        lambda f: F.filter(
            f["opaque"], lambda s: s["value"].rlike(mixed) & ~_meets(s, f["assign"]) & ~_meets(s, f["access"]) & ~_meets(s, f["hex"])
        ),
    )
    scanned = placed.select(
        "doc_id", "text_hash", "owner", "repository", F.concat("assign", "access", "hex").alias("base"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.when(F.size("opaque") > 0, outside).otherwise(F.col("opaque")).alias("opaque"),
    )
    scanned = stored(scanned, "scan")

    # who holds a value: distinct (value, owner, repository) first, so that copies never meet in one task
    held = scanned.select(
        "doc_id", "text_hash", "owner", "repository", F.explode(_values(F.concat("base", "opaque"))).alias("value")
    )
    spread = held.select(F.sha2("value", 256).alias("hash"), _looks_random(F.col("value")).alias("random"), "owner", "repository")
    spread = spread.distinct().groupBy("hash", "random", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    spread = spread.groupBy("hash", "random").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories")
    )
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    verdict = spread.select(
        "hash", "n_owners", "n_repositories", copied.alias("copied"), (~copied & F.col("random")).alias("live")
    )
    per_text = held.select("doc_id", "text_hash", F.sha2("value", 256).alias("hash")).distinct().join(verdict, "hash")
    per_text = per_text.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.when(F.col("live"), F.col("hash"))).alias("live"),
        F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
        F.collect_list(F.struct("hash", "n_owners", "n_repositories")).alias("holders"),
    )
    joined = join_same(scanned, per_text, ["doc_id", "text_hash"], "left")
    live = F.coalesce("live", F.array().cast("array<string>"))
    sought = F.struct(F.array_sort(live).alias("live"), F.col("opaque").alias("opaque"))

    def among(values: Column, hash_: Column) -> Column:
        return F.coalesce(F.get(values, _below(values, lambda h: h <= hash_) - 1) == hash_, F.lit(False))

    added = F.when(
        F.size("opaque") > 0, _let(sought, lambda f: F.filter(f["opaque"], lambda s: _let(F.sha2(s["value"], 256), lambda h: among(f["live"], h))))
    ).otherwise(F.col("opaque"))
    return joined.select("doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base", added.alias("added"), F.size(live).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"), F.coalesce(F.array_sort("holders"), F.array().cast("array<struct<hash:string,n_owners:bigint,n_repositories:bigint>>")).alias("holders")).select(
        "*", _listed(F.col("base")).alias("base_list"), _listed(F.concat("base", "added")).alias("span_list")
    )


def union_spans(spans: Column) -> Column:
    """Spans as ordered, non-overlapping (start, end) pairs."""
    pair = "struct<start:int,end:int>"
    empty = F.array().cast(f"array<{pair}>")

    def step(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        one = F.struct(s["start"].alias("start"), s["end"].alias("end")).cast(pair)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")).cast(pair)
        head = F.slice(state, 1, F.size(state) - 1)
        meets = (F.size(state) > 0) & (s["start"] < F.get(state, F.size(state) - 1)["end"])
        return F.when(meets, F.concat(head, F.array(grown))).otherwise(F.concat(state, F.array(one)))

    def appended(state: Column, part: Column) -> Column:
        """A later piece, in which the pairs don't overlap: those that meet the last pair so far become part of it."""
        last = F.element_at(state, -1)
        reach = F.greatest(last["end"], F.array_max(F.transform(F.filter(part, lambda p: p["start"] < last["end"]), lambda p: p["end"])))
        grown = F.struct(last["start"].alias("start"), reach.alias("end")).cast(pair)
        rest = F.filter(part, lambda p: p["start"] >= last["end"])
        return F.when(F.size(state) == 0, part).otherwise(F.concat(F.slice(state, 1, F.size(state) - 1), F.array(grown), rest))

    def merged(ordered: Column) -> Column:
        return F.aggregate(F.transform(_chunks(ordered), lambda c: F.aggregate(c, empty, step)), empty, appended)

    return F.when(F.size(spans) > 0, _let(F.sort_array(spans), merged)).when(spans.isNotNull(), empty)


def redacted(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns and rows, with the spans of ``secrets(docs)`` replaced by ``mark``.

    Texts without a span, null ones included, stay as they are.
    """
    spans = found.where((F.size("base") > 0) | (F.size("added") > 0)).select(
        "doc_id", "text_hash", F.concat("base", "added").alias("spans")
    ).dropDuplicates(["doc_id", "text_hash"])
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"),
    )
    joined = join_same(rows, spans, ["doc_id", "text_hash"], "left").select("doc", union_spans(F.col("spans")).alias("cuts"))
    text = F.col("doc")[text_col]

    def kept(cuts: Column) -> Column:
        """The text between the cuts; places are sought within the stretch of a piece of cuts, not from the text's start."""
        ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"]))
        starts = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.length(text)))
        between = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

        def stretch(places: Column) -> Column:
            first = F.element_at(places, 1)["start"]
            body = F.substring(text, first + 1, F.element_at(places, -1)["end"] - first)
            return _let(body, lambda b: F.array_join(F.transform(places, lambda p: F.substring(b, p["start"] - first + 1, p["end"] - p["start"])), mark))

        return F.array_join(_let(between, lambda all_: F.transform(_chunks(all_), stretch)), mark)

    clean = F.when(F.col("cuts").isNull(), text).otherwise(_let(F.col("cuts"), kept))
    return joined.select(*[(clean if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
