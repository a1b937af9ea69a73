"""Substring duplicates by anchored blocks: an index of all documents' blocks in place of a Lempel-Ziv parsing.

Every document is cut into reference blocks at places its own words choose: a
block is a longest run of ``window``-word windows with the same smallest hash
of ``ANCHOR`` words (its anchor), so equal passages are cut alike wherever
they stand. All blocks are indexed by anchor and content; a block whose content
stands twice is covered whole. Of the blocks with one anchor and several
contents, or with their anchor twice inside, one of each content is looked up
window by window. The union of covered blocks and windows gives the duplicate
spans, which ``factors`` lists; nothing is parsed greedily, and a span has no
place of reference.

Blocks overlap by ``window - 1`` words, so each window lies in exactly one
block, and equal windows lie in blocks of the same anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm import words as W
from dawnchorus.llm.common import documents_of, join_same, stored

ANCHOR = 12


def _anchor_words(window: int) -> int:
    return min(ANCHOR, max(1, window // 2))


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive values, by doubling."""
    reach, low = 1, values
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return low


class _Windows:
    """Anchor and content hash of every window of a slice; ``at`` lists those within one text."""

    def __init__(self, words: W.Words, window: int):
        self.window, n = window, len(words.hashes)
        if n < window:
            self.at = np.zeros(0, dtype=np.int64)
            return
        k = _anchor_words(window)
        self.grams = W.shingles_of(words.hashes, k)
        self.span = window - k + 1
        self.anchors = _smallest(self.grams, self.span)
        inside = np.zeros(n + 1, dtype=np.int64)
        starts, stops = words.first[:-1], words.first[1:] - window + 1
        long = stops > starts
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, stops[long], -1)
        self.at = np.flatnonzero(np.cumsum(inside)[: n - window + 1])
        up, self.down = W._POWERS.upto(n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words.hashes * up[:n], out=self.total[1:])

    def content(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hash of the words of ``count`` consecutive windows from ``start`` on."""
        stop = start + count + self.window - 1
        return W.mixed((self.total[stop] - self.total[start]) * self.down[start] + count.astype(np.uint64), 17)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, whether the anchor stands twice in it) of each block."""
        at = self.at
        if not len(at):
            return at, at, at.astype(bool)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (self.anchors[at[1:]] != self.anchors[at[:-1]])
        border = np.flatnonzero(new)
        start, count = at[border], np.diff(np.append(border, len(at)))
        span = count + self.span - 1
        first = np.concatenate([[0], np.cumsum(span)[:-1]])
        place = np.arange(span.sum()) + np.repeat(start - first, span)
        hits = self.grams[place] == np.repeat(self.anchors[start], span)
        return start, count, np.add.reduceat(hits.astype(np.int64), first) > 1


def _block_writer(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, shas, lists = [], [], ([], [], [], [], [])
            sizes = []
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                words = W.words_of(data, offsets)
                windows = _Windows(words, window)
                start, count, many = windows.blocks()
                n_words += words.counts.tolist()
                raw = data.tobytes()
                for t in range(end - row):
                    text = raw[offsets[t] : offsets[t + 1]]
                    shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                border = np.searchsorted(start, words.first)
                sizes.append(np.diff(border))
                if len(start):
                    text = np.searchsorted(words.first, start, side="right") - 1
                    parts = (
                        windows.anchors[start].view(np.int64), windows.content(start, count).view(np.int64),
                        (start - words.first[text]).astype(np.int32), count.astype(np.int32), many,
                    )
                    for held, part in zip(lists, parts, strict=True):
                        held.append(part)
            at = pa.array(np.concatenate([[0], *[s for s in sizes]]).cumsum().astype(np.int32))
            kinds = (np.int64, np.int64, np.int32, np.int32, bool)
            columns = [
                pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, k), *held]).astype(k)))
                for held, k in zip(lists, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(n_words, pa.int64()),
                    pa.array(shas, pa.string()), *columns,
                ],
                ["doc_id", "text_hash", "n_words", "words_sha256", "anchor", "content", "start", "n", "many"],
            )

    return run


def _window_writer(window: int):
    """Windows of the blocks listed per text: (anchor, content, row, start, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("looked_up")
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                words = W.words_of(data, offsets)
                windows = _Windows(words, window)
                part = wanted.slice(row, end - row)
                listed = part.flatten()
                if not len(listed):
                    continue
                text = np.repeat(np.arange(end - row), part.value_lengths().to_numpy(zero_copy_only=False))
                start, n, weight = (listed.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                inner = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                own = np.repeat(start, n) + inner
                at = own + words.first[np.repeat(text, n)]
                ids = batch.column("row").to_numpy()[row:end]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(windows.anchors[at].view(np.int64)),
                        pa.array(windows.content(at, np.ones(len(at), dtype=np.int64)).view(np.int64)),
                        pa.array(ids[np.repeat(text, n)]), pa.array(own.astype(np.int32)),
                        pa.array(np.repeat(weight, n).astype(np.int32)),
                    ],
                    ["anchor", "content", "row", "start", "weight"],
                )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, factors = batch.column("text"), batch.column("factors").to_pylist()
        removed, shas = [], []
        for t, spans in enumerate(factors):
            words = texts[t].as_py().encode().split()
            kept, at = [], 0
            for span in spans:
                kept += words[at : span["first"]]
                at = span["last"]
            kept += words[at:]
            removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
            ["row", "n_removed", "kept_sha256"],
        )


FACTORS = "array<struct<first:int,last:int>>"


def _factor_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        spans = [
            [{"first": a, "last": b} for a, b in _merged([(x["first"], x["last"]) for x in row])]
            for row in batch.column("spans").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, kind)], ["row", "factors"])


def substring_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, factors, n_removed, kept_sha256.

    A word is removed if a run of ``window`` words that covers it also starts
    at another place, in the same text or any other row. ``factors`` are the
    removed spans as word positions (end exclusive); ``kept_sha256`` is the
    digest of the kept words joined by one space. Judged on the input. Null
    and blank texts have no word. Repeated rows are copies of each other. Ids
    may repeat or be null. An empty table gives no rows.
    """
    source = documents_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    parsed = stored(
        source.mapInArrow(
            _block_writer(window),
            f"doc_id {kind}, text_hash long, n_words long, words_sha256 string, anchor array<long>, "
            "content array<long>, start array<int>, n array<int>, many array<boolean>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "blocks",
    )
    found = _found_blocks(parsed)
    spans = found.where("copies > 1").select("row", "start", (F.col("start") + F.col("n") + F.lit(window - 1)).alias("end"))

    # texts that are looked into: blocks found in part, or factors that do not cover the text
    looked_up = found.where("look_up").select("row", F.struct("start", "n", F.least("copies", F.lit(2)).cast("int").alias("weight")).alias("block"))
    per_row = spans.select("row", "start", "end", F.lit(None).cast(looked_up.schema["block"].dataType).alias("block")).unionByName(
        looked_up.select("row", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "block")
    )
    per_row = per_row.groupBy("row").agg(
        F.collect_list(F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("first"), F.col("end").alias("last")))).alias("spans"),
        F.collect_list("block").alias("looked_up"),
    )
    ids = parsed.select("row", "doc_id", "text_hash", "n_words")
    listed = per_row.mapInArrow(_list_blocks, f"row long, whole {FACTORS}, looked_up array<struct<start:int,n:int,weight:int>>")
    listed = stored(listed.join(ids, "row"), "listed")
    covered = (F.size("whole") == 1) & (F.col("whole")[0]["first"] == 0) & (F.col("whole")[0]["last"] == F.col("n_words"))
    needed = listed.where(~covered | (F.size("looked_up") > 0)).select("row", "doc_id", "text_hash", "looked_up")
    texts = stored(
        join_same(source, needed, ["doc_id", "text_hash"]).select("row", "text", "looked_up")
        .dropDuplicates(["row"]),
        "texts",
    )
    windows = stored(
        texts.where(F.size("looked_up") > 0).mapInArrow(
            _window_writer(window), "anchor long, content long, row long, start int, weight int"
        ),
        "windows",
    )
    twice = windows.groupBy("anchor", "content").agg(F.sum("weight").alias("w")).where("w > 1").select("anchor", "content")
    borders = windows.where("weight = 1").join(twice, ["anchor", "content"]).select(
        "row", F.struct(F.col("start").alias("first"), (F.col("start") + window).alias("last")).alias("span")
    )
    borders = borders.groupBy("row").agg(F.collect_list("span").alias("border"))
    factors = listed.select("row", "whole").join(borders, "row", "left").select(
        "row", F.concat("whole", F.coalesce("border", F.array().cast(FACTORS))).alias("spans")
    )
    factors = stored(factors.where(F.size("spans") > 0).mapInArrow(_factor_lists, f"row long, factors {FACTORS}"), "factors")
    cut = texts.join(factors, "row").select("row", "text", "factors").mapInArrow(
        _cutter, "row long, n_removed long, kept_sha256 string"
    )
    rest = parsed.select("row", "doc_id", "text_hash", "n_words", "words_sha256").join(factors, "row", "left").join(cut, "row", "left")
    gone = F.col("factors").isNotNull()
    return rest.select(
        "doc_id", "text_hash", "n_words", F.coalesce("factors", F.array().cast(FACTORS)).alias("factors"),
        F.when(gone, F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, F.coalesce("kept_sha256", F.sha2(F.lit(""), 256))).otherwise(F.col("words_sha256")).alias("kept_sha256"),
    )


def _list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        spans = [
            [{"first": a, "last": b} for a, b in _merged([(x["first"], x["last"]) for x in row])]
            for row in batch.column("spans").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(spans, kind), batch.column("looked_up")], ["row", "whole", "looked_up"]
        )


def _found_blocks(parsed: DataFrame) -> DataFrame:
    """Blocks whose anchor stands elsewhere too: (row, start, n, copies, look_up).

    ``copies`` counts blocks of the same content. ``look_up`` marks one block of
    each content under an anchor with several contents, or with its anchor
    twice inside: those windows are compared one by one.
    """
    zipped = F.arrays_zip("anchor", "content", "start", "n", "many")
    blocks = parsed.select("row", F.explode(zipped).alias("b")).select("row", "b.*")
    anchors = blocks.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("blocks"), F.min("content").alias("low"), F.max("content").alias("high"),
        F.max("many").alias("any_many"),
    )
    anchors = anchors.where("blocks > 1 OR any_many").select("anchor", (F.col("low") != F.col("high")).alias("several"), "any_many")
    shared = stored(blocks.join(anchors, "anchor"), "shared")
    contents = shared.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start")).alias("example")
    )
    own = F.struct("row", "start")
    return shared.join(contents, ["anchor", "content"]).select(
        "row", "start", "n", "copies",
        ((F.col("several") | F.col("any_many")) & (own == F.col("example"))).alias("look_up"),
    )
