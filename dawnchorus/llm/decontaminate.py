"""Benchmark items inside long documents: size-partitioned MinHash containment search, confirmed exactly.

Benchmark items are partitioned by their number of shingles into classes
(powers of two). For a class of size ``u`` a document is covered by windows of
``2 * u`` shingles at every ``u``: an item of the class that stands in the
document lies within one window, and the Jaccard similarity of item and window
is at least about a fifth, however long the document. Minima of ``PERMUTATIONS``
hashes are taken once per block of the smallest class; larger windows are
merged from smaller ones. A window whose minimum equals an item's under any
permutation makes a candidate; a candidate counts if the whole document's
distinct shingles hold at least ``percent`` per cent of the item's.

A contained item is missed by the search with a chance of about
``(1 - 0.2) ** PERMUTATIONS``, 6e-7.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm import words as W
from dawnchorus.llm.common import documents_of, drop_stored, stored

PERMUTATIONS = 64
BLOCK_BYTES = 8_000_000  # of item shingles that go to the tasks at a time
_RUN = 1 << 15


def _item_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                values, first = W.distinct_runs(*W.shingle_runs(W.words_of(data, offsets, fold=True), size))
                sets = [values[first[i] : first[i + 1]].tobytes() for i in range(end - row)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(row, end - row), pa.array(sets, pa.binary())], ["item_id", "shingles"]
                )

    return run


class _Index:
    """Items of one block, by class, with a sorted table of their minima."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.factors = W._odd(PERMUTATIONS, 91)
        sizes = np.array([len(s) for s in sets])
        classes = 1 << np.ceil(np.log2(sizes)).astype(int)
        self.smallest = int(classes.min())
        self.levels = {}
        for u in sorted(set(classes.tolist())):
            members = np.flatnonzero(classes == u)
            minima = np.array([[(sets[m] * f).min() for f in self.factors] for m in members])
            bits = min(22, int(np.ceil(np.log2(4096 * len(members)))))
            seen = np.zeros((PERMUTATIONS, 1 << bits), dtype=bool)
            for p in range(PERMUTATIONS):
                seen[p, minima[:, p] & np.uint64((1 << bits) - 1)] = True
            order = np.argsort(minima, axis=0, kind="stable")
            self.levels[u] = (bits, seen, np.take_along_axis(minima, order, axis=0), members[order])

    def block_minima(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), PERMUTATIONS), dtype=np.uint64)
        border = np.append(at, len(values))
        b = 0
        while b < len(at):
            end = max(b + 1, int(np.searchsorted(border, border[b] + _RUN, side="right")) - 1)
            run = values[border[b] : border[end]]
            for p in range(PERMUTATIONS):
                out[b:end, p] = np.minimum.reduceat(run * self.factors[p], at[b:end] - border[b])
            b = end
        return out

    def candidates(self, values: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs whose minima meet in some window; every text here has shingles."""
        blocks = -(-np.diff(first) // self.smallest)
        edge = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(blocks)), blocks)
        minima = self.block_minima(values, first[text] + (np.arange(edge[-1]) - edge[text]) * self.smallest)
        found: set[tuple[int, int]] = set()
        u = self.smallest
        last = max(self.levels)
        while True:
            if u in self.levels:
                window = minima.copy()
                joined = np.flatnonzero(text[1:] == text[:-1])
                window[joined] = np.minimum(minima[joined], minima[joined + 1])
                found |= self._met(u, window, text)
            if u == last:
                return found
            start = np.flatnonzero((np.arange(len(text)) - edge[text]) % 2 == 0)
            minima, text = np.minimum.reduceat(minima, start, axis=0), text[start]
            edge = np.searchsorted(text, np.arange(len(edge)))
            u *= 2

    def _met(self, u: int, window: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
        bits, seen, minima, members = self.levels[u]
        hit = seen[np.arange(PERMUTATIONS), window & np.uint64((1 << bits) - 1)]  # low bits: minima are small
        found = set()
        for w, p in zip(*np.nonzero(hit), strict=True):
            value, column = window[w, p], minima[:, p]
            for k in range(np.searchsorted(column, value), np.searchsorted(column, value, side="right")):
                found.add((int(text[w]), int(members[k, p])))
        return found


def _found(column: pa.Array, index: _Index, size: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of one string column."""
    for row, _, data, offsets in W.text_slices(column):
        values, first = W.shingle_runs(W.words_of(data, offsets, fold=True), size)
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            continue
        at = np.append(first[some], len(values))
        for t, item in sorted(index.candidates(values, at)):
            wanted = index.sets[item]
            shared = int(np.isin(wanted, values[at[t] : at[t + 1]]).sum())
            if 100 * shared >= percent * len(wanted):
                yield row + int(some[t]), item, shared


def _item_blocks(
    benchmark: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int
) -> Iterator[tuple[list, list[bytes], bool]]:
    """Item ids and shingle sets of a stated query set, a block of about ``block_bytes`` at a time, and whether it is the only one.

    The sets of several blocks are written to the shared folder, from which
    the driver fetches one block after the other.
    """
    items = documents_of(benchmark, item_col, text_col).withColumnRenamed("doc_id", "item_id")
    kind = items.schema["item_id"].dataType.simpleString()
    sets = items.mapInArrow(_item_shingles(size), f"item_id {kind}, shingles binary").where(F.length("shingles") > 0)
    total = sets.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    if n > 1:
        sets = stored(sets, "benchmark-sets")
    for b in range(n):
        rows = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(n)) == b).sort("item_id", "shingles").collect()
        if rows:
            yield [r[0] for r in rows], [bytes(r[1]) for r in rows], n == 1
    if n > 1:
        drop_stored(sets)


def _index(packed: bytes) -> _Index:
    return _Index([np.frombuffer(s, dtype=np.uint64) for s in pickle.loads(packed)])


def contained_items(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", words: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row and benchmark item it contains: doc_id, item_id, n_item, n_shared, containment.

    Shingles are distinct runs of ``words`` words, A-Z lower-cased; a text with
    fewer words is one shingle, so a short item is found only as a whole
    text. Null, empty and blank texts and items contain nothing and are
    contained in nothing. Repeated rows are reported each. Ids may be null.
    Items beyond one block of shingle sets are searched block by block when this is
    called, each block's hits written before the next is fetched: the driver and a task hold one.
    """
    source = documents_of(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(item_kind)
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, n_item long, n_shared long, containment double"

    def searcher(ids: list, packed: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(packed)
            for batch in batches:
                hits = list(_found(batch.column("text"), index, words, percent))
                if hits:
                    n_item = [len(index.sets[i]) for _, i, _ in hits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array([r for r, _, _ in hits])),
                            pa.array([ids[i] for _, i, _ in hits], arrow_kind), pa.array(n_item, pa.int64()),
                            pa.array([s for _, _, s in hits], pa.int64()),
                            pa.array([s / n for (_, _, s), n in zip(hits, n_item, strict=True)]),
                        ],
                        ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )

        return run

    out = source.sparkSession.createDataFrame([], schema)
    for ids, sets, only in _item_blocks(benchmark, item_col, item_text_col, words, block_bytes):
        hits = source.mapInArrow(searcher(ids, pickle.dumps(sets)), schema)
        out = out.unionByName(hits if only else stored(hits, "benchmark-hits"))
    return out


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text_col: str = "text",
    words: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``docs``, all columns, that contain no benchmark item; nothing is shuffled.

    Rows with null or blank text stay. Items beyond one block are searched block
    by block when this is called; what a block keeps is written and read by the next.
    """

    def keeper(packed: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(packed)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, _, _ in _found(batch.column(text_col), index, words, percent):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return run

    first = benchmark.withColumn("_none", F.lit(None).cast("long")).select("_none", F.col(f"`{item_text_col}`").alias("_text"))
    kept = None
    for _, sets, only in _item_blocks(first, "_none", "_text", words, block_bytes):
        clean = (docs if kept is None else kept).mapInArrow(keeper(pickle.dumps(sets)), docs.schema)
        if only:
            return clean
        before, kept = kept, stored(clean, "decontaminated")
        if before is not None:
            drop_stored(before)
    return docs if kept is None else kept
