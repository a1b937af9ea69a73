"""Near duplicates by min-max hashing: smallest and largest hash per permutation, banded, confirmed exactly.

Documents with the same set of word shingles form one node. Each of
``permutations`` hash functions is evaluated once per shingle and gives two
signature values, its minimum and its maximum; both agree between two sets
with the probability of their Jaccard similarity. Bands of ``rows`` values are
buckets. Inside a bucket pairs are compared in blocks: a pair is taken in the
first band it shares only, by the bands' whole keys as in the buckets, skipped
where its one-byte signature is ``SLACK`` below the threshold (over six standard
deviations; bytes that agree by chance only raise it), and confirmed on the full
sets unless both are already connected in that block. Groups are returned as
spanning links, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm import words as W
from dawnchorus.llm.common import components, documents_of, drop_stored, join_same, stored, whole_groups

SLACK = 0.17
BLOCK_ROWS = 1500
BLOCK_BYTES = 16_000_000
_RUN = 1 << 15  # shingles hashed at a time, so that they stay in the processor's cache


def min_max(values: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """Signature of each non-empty run: columns 2p and 2p+1 are minimum and maximum of permutation p."""
    n = len(first) - 1
    out = np.empty((n, 2 * permutations), dtype=np.uint64)
    factors = W._odd(permutations, 55)
    buffer = np.empty(0, dtype=np.uint64)
    t = 0
    while t < n:
        end = max(t + 1, int(np.searchsorted(first, first[t] + _RUN, side="right")) - 1)
        run, at = values[first[t] : first[end]], first[t:end] - first[t]
        if len(buffer) < len(run):
            buffer = np.empty(len(run), dtype=np.uint64)
        hashed = buffer[: len(run)]
        for p in range(permutations):
            np.multiply(run, factors[p], out=hashed)
            out[t:end, 2 * p] = np.minimum.reduceat(hashed, at)
            out[t:end, 2 * p + 1] = np.maximum.reduceat(hashed, at)
        t = end
    return out


def _digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes per non-empty run of distinct values, independent of their order."""
    sums = [np.add.reduceat(W.mixed(values, seed), first[:-1]) for seed in (101, 202)]
    size = np.diff(first).astype(np.uint64)
    return np.ascontiguousarray(np.stack([W.mixed(s + size, 3) for s in sums], axis=1)).view(np.uint8)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, positions with shingles, their distinct shingles, first places) of each slice."""
    for row, _, data, offsets in W.text_slices(column):
        values, first = W.distinct_runs(*W.shingle_runs(W.words_of(data, offsets, fold=True), size))
        some = np.flatnonzero(np.diff(first))
        yield row, some, values, np.append(first[some], len(values))


def _signer(size: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros(n, dtype=np.int64)
            nodes, keys, sigs = [None] * n, [None] * n, [None] * n
            for row, some, values, first in _sets(batch.column("text"), size):
                if not len(some):
                    continue
                counts[row + some] = np.diff(first)
                sig = min_max(values, first, rows * bands // 2)
                by_band = sig.reshape(len(some), bands, rows)
                key = W.mixed((by_band * W._odd(rows, 77)).sum(axis=2) + W._odd(bands, 78)).view(np.int64)
                digest, low = _digests(values, first), (W.mixed(sig, 9) & np.uint64(255)).astype(np.uint8)
                for i, t in enumerate(some):
                    nodes[row + t], keys[row + t], sigs[row + t] = digest[i].tobytes(), key[i], low[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(counts), pa.array(nodes, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "node", "keys", "sig"],
            )

    return run


def _set_writer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node")
            for row, some, values, first in _sets(batch.column("text"), size):
                for i, t in enumerate(some):
                    yield pa.RecordBatch.from_arrays(
                        [nodes.slice(row + t, 1), pa.array([values[first[i] : first[i + 1]].tobytes()], pa.binary())],
                        ["node", "members"],
                    )

    def gathered(batches):
        held, size_now = [], 0
        for b in run(batches):
            held.append(b)
            size_now += b.nbytes
            if size_now > 4_000_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size_now = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


class _Pairs:
    """Pairs of one block pair that may be similar, row by row."""

    def __init__(self, table: pa.Table, start: int, end: int, percent: int):
        part = table.slice(start, end - start)
        self.sig = np.frombuffer(b"".join(part["sig"].to_pylist()), dtype=np.uint8).reshape(end - start, -1)
        self.size = part["n_shingles"].to_numpy()
        self.block = part["block"].to_numpy()
        # keys of the bands before this one: all rows of a bucket have as many
        self.earlier = part["earlier"].combine_chunks().flatten().to_numpy().reshape(end - start, -1)
        self.within = part["low"][0].as_py() == part["high"][0].as_py()
        self.percent = percent
        self.least = (percent / 100 - SLACK) * self.sig.shape[1]

    def partners(self, i: int) -> np.ndarray:
        """Later rows that share this band first with row ``i`` and look similar enough."""
        rest = slice(i + 1, None)
        size, own = self.size[rest], self.size[i]
        near = self.percent * np.maximum(size, own) <= 100 * np.minimum(size, own)
        if not self.within:
            near &= self.block[rest] != self.block[i]
        at = np.flatnonzero(near)
        if not len(at):
            return at
        alike = (self.sig[i + 1 + at] == self.sig[i]).sum(axis=1) >= self.least
        at = at[alike] + i + 1
        return at[~(self.earlier[at] == self.earlier[i]).any(axis=1)]


BLOCK_KEYS = ["key", "band", "low", "high"]


def _promising(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, BLOCK_KEYS):
            keep = np.zeros(table.num_rows, dtype=bool)
            for start, end in zip(at[:-1], at[1:], strict=True):
                if end - start < 2:
                    continue
                pairs = _Pairs(table, start, end, percent)
                for i in range(end - start - 1):
                    found = pairs.partners(i)
                    if len(found):
                        keep[start + i] = True
                        keep[start + found] = True
            if keep.any():
                yield from table.filter(pa.array(keep)).to_batches()

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, BLOCK_KEYS):
            links = []
            for start, end in zip(at[:-1], at[1:], strict=True):
                if end - start >= 2:
                    links += _spanning(table, start, end, percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _spanning(table: pa.Table, start: int, end: int, percent: int) -> list[tuple[bytes, bytes]]:
    pairs = _Pairs(table, start, end, percent)
    nodes = table["node"].slice(start, end - start).to_pylist()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table["members"].slice(start, end - start).to_pylist()]
    root = np.arange(len(nodes))
    links = []
    for i in range(len(nodes) - 1):
        found = pairs.partners(i)
        found = found[root[found] != root[i]]
        while len(found):
            j, found = found[0], found[1:]
            shared = np.searchsorted(sets[i], sets[j])
            shared[shared == len(sets[i])] = 0
            n = int((sets[i][shared] == sets[j]).sum())
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                links.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
                found = found[root[found] != root[i]]
    return links


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    rows: int = 6, bands: int = 36,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, node, component_id, kept_row.

    Two documents are linked where ``100 * intersection >= percent * union`` of
    their sets of distinct ``words``-word shingles (A-Z lower-cased). A document
    with fewer words has one shingle, its whole sequence. Null, empty and
    blank texts have no shingle, no node and no link; their component is their
    own id. ``component_id`` is the smallest id reachable (nulls aside);
    ``kept_row`` marks the smallest (doc_id, text_hash) of a component, the same
    for repeated rows. Ids may repeat or be null: nodes are known by their
    shingle set, not by an id. An empty table gives no rows.

    A link at the threshold shares a band except for a chance of
    ``(1 - (percent/100)**rows) ** bands``, 4e-8 at 85 and 2e-5 at 80 per cent.
    """
    source = documents_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = stored(
        source.mapInArrow(
            _signer(words, rows, bands),
            f"doc_id {kind}, text_hash long, n_shingles long, node binary, keys array<long>, sig binary",
        ),
        "signatures",
    )
    nodes = stored(
        signed.where("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("row"),
            F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sig").alias("sig"),
        ),
        "nodes",
    )
    links = _links(source, nodes, words, percent)
    roots = stored(
        nodes.select("node", "least", "row").join(components(links), "node", "left").select(
            "node", "least", "row", F.coalesce("root", "node").alias("root")
        ),
        "roots",
    )
    drop_stored(nodes)
    by_root = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("keeper"))
    by_node = roots.select("node", "root").join(by_root, "root").select("node", "component_id", "keeper")
    slim = signed.select("doc_id", "text_hash", "n_shingles", "node")
    found = slim.where("node IS NOT NULL").join(by_node, "node")
    own = F.struct("doc_id", "text_hash")
    return found.select(
        "doc_id", "text_hash", "n_shingles", "node", "component_id", own.eqNullSafe(F.col("keeper")).alias("kept_row")
    ).unionByName(
        slim.where("node IS NULL").select(
            "doc_id", "text_hash", "n_shingles", "node", F.col("doc_id").alias("component_id"),
            F.lit(True).alias("kept_row"),
        )
    )


def _links(source: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links that span every group of nodes, as (a, b)."""
    placed = nodes.select("node", "n_shingles", F.posexplode("keys").alias("band", "key"))
    sizes = placed.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("volume")).where("n > 1")
    blocks = F.greatest(
        F.ceil(F.col("n") / F.lit(BLOCK_ROWS)), F.ceil(F.col("volume") * 8 / F.lit(BLOCK_BYTES))
    ).cast("int")
    members = placed.join(sizes, ["key", "band"]).select("key", "band", "node", blocks.alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = members.join(nodes.select("node", "n_shingles", "sig", "keys"), "node")
    dealt = dealt.withColumn("earlier", F.slice("keys", 1, F.col("band")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "band", "node", "n_shingles", "sig", "earlier", "block", other).select(
        "key", "band", "node", "n_shingles", "sig", "earlier", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    promising = stored(
        dealt.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(_promising(percent), dealt.schema),
        "promising",
    )
    wanted = promising.select("node").distinct().join(nodes.select("node", "row"), "node")
    wanted = wanted.select("node", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"))
    texts = join_same(source, wanted, ["doc_id", "text_hash"]).select("node", "text")
    sets = stored(
        texts.mapInArrow(_set_writer(words), "node binary, members binary").dropDuplicates(["node"]), "sets"
    )
    full = promising.join(sets, "node")
    links = stored(
        full.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(
            _confirmed(percent), "a binary, b binary"
        ),
        "links",
    )
    drop_stored(promising)
    drop_stored(sets)
    return links


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group of near duplicates.

    Rows that repeat a kept id and text count as copies and go too. Null, empty
    and blank texts are linked with nothing; only their repeated ids go.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, percent=percent).where("kept_row")
    kept = kept.select("doc_id", "text_hash").distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"),
    )
    chosen = join_same(rows, kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return chosen.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
