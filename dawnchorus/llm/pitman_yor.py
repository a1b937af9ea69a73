"""A hierarchical Pitman-Yor language model: every word is a context with its own restaurant below one shared parent.

A restaurant's customers are the words that follow its context in training
documents; each sits at a table of its word, and every table sends a customer
to the parent, whose own base is uniform. Gibbs sampling takes customers from
their seats and seats them again; the predictive probability of a word is
averaged over samples.

How it spreads: documents are cut in blocks, and a block sends its distinct
(context, word) pairs once to each bucket of contexts. Buckets seat their restaurants, send table
counts by word to the parent's slots, get the parent's state back, seat again
and answer every block's pairs with probabilities, which the block adds up by
document. A bucket holds some 2M tokens whatever the corpus; contexts with
more than a two-thousandth of all tokens are dealt over all buckets by word, so
no restaurant needs to fit in a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import documents_of, drop_stored, stored
from dawnchorus.llm.words import mixed, text_slices, words_of

BUCKET_TOKENS, LEAST_BUCKETS = 1 << 21, 32
BLOCK_TOKENS = 1 << 21
HOT_SHARE = 2000  # contexts above this part of all tokens are dealt out by word
BURN_IN, SAMPLES = 2, 2  # sweeps, samples
ROUNDS = 24  # of a sweep, which takes up every customer in one of them
ROOT_DISCOUNT, ROOT_STRENGTH = 0.65, 1.0
FIRST_GUESS = (0.75, 10.0)  # discount and strength of the contexts in the first seating
#: Discounts and strengths among which the leave-one-out likelihood of all training tokens chooses.
GRID = [(d, s) for d in (0.5, 0.75, 0.9) for s in (1.0, 30.0, 1000.0, 30_000.0)]
FINE = 10_000.0  # a pair's log10 travels in ten thousandths, far finer than two samples tell apart
_BEGIN, _END = np.uint64(1), np.uint64(2)  # the context of a first word, and the token after the last


def held_out(doc_id, *, folds: int = 5, fold: int = 1) -> bool:
    """Whether the CRC-32 of the decimal id leaves ``fold``; a null id is learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _z(values: np.ndarray, dtype) -> bytes:
    """Numbers compressed byte by byte of their width: the high bytes of small numbers shrink to nothing."""
    import zstandard

    planes = np.ascontiguousarray(values, dtype=dtype).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _un(data: bytes, dtype) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of the keys, and every key's rank among them (faster than ``np.unique``)."""
    order = np.argsort(keys)
    keys = keys[order]
    opens = np.ones(len(keys), dtype=bool)
    opens[1:] = keys[1:] != keys[:-1]
    del keys
    rank = np.empty_like(order)
    rank[order] = np.cumsum(opens)
    rank -= 1
    return order[opens], rank


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), dtype=bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _tokens(batch: pa.RecordBatch):
    """Runs of whole texts: (row, end row, tokens, contexts, first token of each text and the end)."""
    for row, end, data, offsets in text_slices(batch.column("text")):
        words = words_of(data, offsets, fold=True)
        tokens = np.insert(words.hashes, words.first[1:], _END)
        first = words.first + np.arange(len(words.first))
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[first[:-1]] = _BEGIN
        yield row, end, tokens, before, first


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each slice, and its contexts that may be frequent in the whole."""
    for batch in batches:
        for _, _, tokens, before, _ in _tokens(batch):
            contexts, n = np.unique(before, return_counts=True)
            often = n * (2 * HOT_SHARE) >= len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *contexts[often].view(np.int64).tolist()], pa.int64()), pa.array([len(tokens), *n[often].tolist()])],
                ["context", "n"],
            )


def _dealt(contexts: np.ndarray, words: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    key = np.where(_among(contexts, hot), mixed(contexts ^ mixed(words, 5), 6), mixed(contexts, 7))
    return (key % np.uint64(buckets)).astype(np.int64)


def _pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    keys = contexts * np.uint64(0x9E3779B97F4A7C15)
    keys += words
    return mixed(keys, 3)


def _blocks(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int):
    """Blocks of whole texts: ids, held out, tokens per text, tokens' places among the pairs, the pairs by bucket."""

    def block(held):  # which it empties; arrays are dropped as soon as they can be, as a block's are large
        ids, out, tokens, before, sizes = ([x for h in held for x in h[0]], *(np.concatenate([h[k] for h in held]) for k in range(1, 5)))
        held.clear()
        at, place = _distinct(_pair_keys(before, tokens))
        contexts, words = before[at], tokens[at]
        del before, tokens, at
        learned = np.bincount(place[np.repeat(~out, sizes)], minlength=len(words))
        bucket = _dealt(contexts, words, hot, buckets)
        bits = np.uint64(buckets.bit_length())
        _, order = _distinct(bucket.astype(np.uint64) << (np.uint64(64) - bits) | contexts >> bits)
        order <<= 32
        order |= np.arange(len(order))
        order.sort()  # no ties: both readings number the pairs alike
        order &= 0xFFFFFFFF
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        place = rank[place]
        del rank
        contexts, words = contexts[order], words[order]
        learned, bucket = learned[order], bucket[order]
        return ids, out, sizes, place, contexts, words, learned, bucket

    held, n = [], 0
    for batch in batches:
        for row, end, tokens, before, first in _tokens(batch):
            ids = batch.column("doc_id").slice(row, end - row).to_pylist()
            out = np.array([held_out(i) for i in ids], dtype=bool)
            held.append((ids, out, tokens, before, np.diff(first)))
            n += len(tokens)
            if n >= BLOCK_TOKENS:
                yield block(held)
                held, n = [], 0
    if held:
        yield block(held)


def _name(n: int) -> str:
    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId()}-{n}"


_SENT = "bucket int, block string, contexts binary, runs binary, words binary, word_at binary, learned binary"


def _sender(hot, buckets):
    """A block's pairs, a row for each bucket that gets any."""

    def run(batches):
        k = -1
        for *_, contexts, words, learned, bucket in _blocks(batches, hot, buckets):  # enumerate would hold all columns
            del _
            k += 1
            name = _name(k)
            for b, low, high in _groups(bucket):
                c, runs = _runs(contexts[low:high])
                w, at = np.unique(words[low:high], return_inverse=True)
                packed = [_z(c, np.uint64), _z(runs, np.uint32), _z(w, np.uint64), _z(at, np.uint32), _z(learned[low:high], np.uint32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([name]), *[pa.array([x], pa.binary()) for x in packed]],
                    ["bucket", "block", "contexts", "runs", "words", "word_at", "learned"],
                )

    return run


def _groups(values: np.ndarray):
    """(value, first, end) of each run of equal values."""
    at = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)], strict=True)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(at, append=len(values))


def _documents(hot, buckets, id_type):
    """A row per block: its documents, and their tokens as places among the block's pairs."""

    def run(batches):
        k = -1
        for ids, out, sizes, place, *_ in _blocks(batches, hot, buckets):
            del _
            k += 1
            place |= np.repeat(np.arange(len(ids)) << 32, sizes)
            place.sort()  # within a document, whose steps are small
            place &= 0xFFFFFFFF
            place[1:] -= place[:-1].copy()
            columns = [[_name(k)], [ids], [out.tolist()], [sizes.tolist()], [_z(place, np.int32)]]
            types = [pa.string(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "ids", "held_out", "sizes", "steps"]
            )

    return run


class Seating:
    """Tables of the words of several restaurants.

    ``customers`` and ``room`` give each word's customers and restaurant;
    words with a single customer have one table for ever. ``base`` is the
    parent's probability of each word, ``extra`` the tables that a restaurant has elsewhere.
    """

    def __init__(self, customers: np.ndarray, room: np.ndarray, rooms: int, rng: np.random.Generator, extra: np.ndarray | None = None):
        self.rng, self.customers, self.room = rng, customers, room
        self.many = np.flatnonzero(customers > 1)
        self.fixed = np.bincount(room[customers == 1], minlength=rooms).astype(np.float64)
        if extra is not None:
            self.fixed += extra
        self.owner = np.arange(len(self.many))  # of each table, ascending
        self.size = customers[self.many].astype(np.int64)

    def tables(self) -> np.ndarray:
        """Tables per word."""
        out = (self.customers == 1).astype(np.int64)
        out[self.many] = np.bincount(self.owner, minlength=len(self.many))
        return out

    def per_room(self) -> np.ndarray:
        mine = np.bincount(self.owner, minlength=len(self.many))
        return self.fixed + np.bincount(self.room[self.many], weights=mine, minlength=len(self.fixed))

    def _drawn(self, weights: np.ndarray, slots: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Customers that come to each table: of every word, whose tables are its next ``slots``, ``times``, by weight."""
        upto = np.cumsum(weights)
        last = np.cumsum(slots) - 1
        end = upto[last]
        start = np.concatenate([[0.0], end[:-1]])
        word = np.repeat(np.arange(len(slots)), times)
        at = np.searchsorted(upto, start[word] + self.rng.random(len(word)) * (end - start)[word], "right")
        return np.bincount(np.minimum(at, last[word]), minlength=len(weights))

    def _rounds(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each round the tables, ascending, that lose customers, and how many; every customer draws its round."""
        large = self.size > 2 * ROUNDS  # drawn as a whole, so that nothing here is as long as a word's customers
        few, many = np.flatnonzero(~large), np.flatnonzero(large)
        key = np.repeat(few, self.size[few])
        key += self.rng.integers(0, ROUNDS, len(key)) * len(large)
        key.sort()
        at = np.flatnonzero(np.diff(key, prepend=-1))
        amount = np.diff(at, append=len(key))
        key = key[at]
        if len(many):
            drawn = self.rng.multinomial(self.size[many], np.full(ROUNDS, 1 / ROUNDS))
            some = np.nonzero(drawn)
            key = np.concatenate([key, many[some[0]] + some[1] * len(large)])
            order = np.argsort(key)
            key, amount = key[order], np.concatenate([amount, drawn[some]])[order]
        edges = np.searchsorted(key, np.arange(ROUNDS + 1) * len(large)).tolist()
        for r, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            if low < high:
                yield key[low:high] - r * len(large), amount[low:high]

    def sweep(self, base: np.ndarray, discount: float, strength: float) -> None:
        """Take every customer from its seat once and seat it again; a round's customers of one word go together.

        Every customer draws its round first, so that a round looks at no words but its customers' own.
        """
        if not len(self.many):
            return
        room, base, customers = self.room[self.many], base[self.many], self.customers[self.many]
        tables = np.bincount(self.owner, minlength=len(self.many))
        in_room = self.per_room()
        # A word has slots for its tables and for some to come; a table without customers keeps its slot during the sweep.
        slots = tables + np.minimum(customers, 4 * tables + 50)
        begin = np.cumsum(slots) - slots
        used = tables.copy()
        slot = np.arange(len(self.owner)) + (begin - (np.cumsum(tables) - tables))[self.owner]
        size = np.zeros(int(slots.sum()), dtype=np.int64)
        size[slot] = self.size
        for table, amount in self._rounds():
            word, at = self.owner[table], slot[table]
            opens = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            word, n = word[opens], np.add.reduceat(amount, opens)
            size[at] -= amount
            closed = np.add.reduceat((size[at] == 0).astype(np.int64), opens)
            tables[word] -= closed
            np.subtract.at(in_room, room[word], closed.astype(np.float64))
            new = (strength + discount * in_room[room[word]]) * base[word]
            first = tables[word] == 0  # no table is left: one opens, and the others may join it
            old = customers[word] - n - discount * tables[word] + (n - 1) / 2
            opened = first + self.rng.binomial(n - first, new / (new + old))
            if (used[word] + opened > slots[word]).any():
                more = np.where(2 * used > slots, np.minimum(2 * slots, used + customers), slots)
                more[word] = np.maximum(more[word], 2 * (used[word] + opened))
                moved = np.cumsum(more) - more
                grown = np.zeros(int(more.sum()), dtype=np.int64)
                grown[_spread(moved, used)] = size[_spread(begin, used)]
                slot += (moved - begin)[self.owner]
                slots, begin, size = more, moved, grown
            size[_spread(begin[word] + used[word], opened)] = 1
            used[word] += opened
            tables[word] += opened
            np.add.at(in_room, room[word], opened.astype(np.float64))
            joins = np.flatnonzero(n > opened)
            if len(joins):
                word, n = word[joins], (n - opened)[joins]
                at = _spread(begin[word], used[word])
                size[at] += self._drawn(np.maximum(size[at] - discount, 0), used[word], n)
        kept = np.flatnonzero(size)
        self.owner, self.size = np.repeat(np.arange(len(self.many)), slots)[kept], size[kept]


def _spread(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs: ``lengths`` of them from ``begin`` on."""
    return np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)


def predictive(customers, tables, base, room_customers, room_tables, discount, strength):
    """Probability of the next customer being of each word."""
    return (np.maximum(customers - discount * tables, 0) + (strength + discount * room_tables) * base) / (strength + room_customers)


def _bucket(sent: pa.Table):
    """The pairs of a bucket, the same from every block: contexts, words, learned, and the places of each block's pairs."""
    rows = [(r["block"], _un(r["contexts"], np.uint64), _un(r["runs"], np.uint32), _un(r["words"], np.uint64),
             _un(r["word_at"], np.uint32), _un(r["learned"], np.uint32)) for r in sent.to_pylist()]
    contexts = np.concatenate([np.repeat(c, n) for _, c, n, _, _, _ in rows])
    words = np.concatenate([w[at] for _, _, _, w, at, _ in rows])
    at, place = _distinct(_pair_keys(contexts, words))
    learned = np.bincount(place, weights=np.concatenate([r[5] for r in rows]), minlength=len(at)).astype(np.int64)
    ends = np.cumsum([len(r[4]) for r in rows])
    blocks = [(r[0], place[end - len(r[4]) : end]) for r, end in zip(rows, ends, strict=True)]
    return contexts[at], words[at], learned, blocks


def _rooms(contexts: np.ndarray, learned: np.ndarray):
    rooms, room = np.unique(contexts, return_inverse=True)
    return rooms, room, np.bincount(room, weights=learned, minlength=len(rooms))


def _loo(learned, tables, base, room, room_customers, room_tables) -> list[float]:
    """Log likelihood of all customers, each seen from the others, for every pair of the grid."""
    some = learned > 0
    c, t, p, r = learned[some], tables[some], base[some], room[some]
    left = np.minimum(t, c - 1)
    full, seats = room_customers[r] - 1, room_tables[r] - (t - left)
    return [float((c * np.log(predictive(c - 1, left, p, full, seats, d, s))).sum()) for d, s in GRID]


_WORDS = "slot int, bucket int, words binary, learned binary, tables array<binary>, names array<int>, amounts array<double>"
# Names of the sums over the whole corpus: the grid's likelihoods, training tokens, distinct training words, then
# the parent's customers and tables per sample, then per frequent context its customers and its tables per sample.
_N, _V = len(GRID), len(GRID) + 1
_PARENT = len(GRID) + 2


def _first_seating(hot, slots):
    """Words of a bucket with their training tokens and tables per sample, by slot."""
    hot_at = _PARENT + 2 * SAMPLES

    def run(sent: pa.Table) -> pa.Table:
        number = sent["bucket"][0].as_py()
        contexts, words, learned, _ = _bucket(sent)
        rooms, room, room_customers = _rooms(contexts, learned)
        names, word = np.unique(words, return_inverse=True)
        count = np.bincount(word, weights=learned, minlength=len(names))
        known = max(int((count > 0).sum()), 1)
        base = ((count + 0.5) / (count.sum() + 0.5 * (known + 1)))[word]
        seating = Seating(learned, room, len(rooms), np.random.default_rng([1, number]))
        for _ in range(BURN_IN):
            seating.sweep(base, *FIRST_GUESS)
        sums = dict(enumerate(_loo(learned, seating.tables(), base, room, room_customers, seating.per_room())))
        frequent = np.flatnonzero(np.isin(rooms, hot))
        which = np.searchsorted(hot, rooms[frequent])
        per_word = []
        for s in range(SAMPLES):
            seating.sweep(base, *FIRST_GUESS)
            tables = seating.tables()
            per_word.append(np.bincount(word, weights=tables, minlength=len(names)))
            there = seating.per_room()
            for k, r in zip(which.tolist(), frequent.tolist(), strict=True):
                at = hot_at + k * (1 + SAMPLES)
                sums[at], sums[at + 1 + s] = float(room_customers[r]), float(there[r])
        slot = (mixed(names, 9) % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        out = [
            (g, number, _z(names[order[low:high]], np.uint64), _z(count[order[low:high]], np.uint32),
             [_z(t[order[low:high]], np.uint32) for t in per_word], None, None)
            for g, low, high in _groups(slot[order])
        ]
        out.append((number % slots, number, None, None, None, list(sums), list(sums.values())))
        return _table(out, _WORDS_TYPES)

    return run


_WORDS_TYPES = [
    ("slot", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("learned", pa.binary()),
    ("tables", pa.list_(pa.binary())), ("names", pa.list_(pa.int32())), ("amounts", pa.list_(pa.float64())),
]
_TOLD = "bucket int, words binary, learned binary, customers array<binary>, tables array<binary>, names array<int>, amounts array<double>"
_TOLD_TYPES = [
    ("bucket", pa.int32()), ("words", pa.binary()), ("learned", pa.binary()), ("customers", pa.list_(pa.binary())),
    ("tables", pa.list_(pa.binary())), ("names", pa.list_(pa.int32())), ("amounts", pa.list_(pa.float64())),
]


def _table(rows: list[tuple], types) -> pa.Table:
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])


def _parent(table: pa.Table) -> pa.Table:
    """The parent's restaurant for the words of one slot, told to every bucket that asked for them; its sums."""
    sums: dict[int, float] = {}
    asked = []
    for r in table.to_pylist():
        if r["names"] is not None:
            for n, x in zip(r["names"], r["amounts"], strict=True):
                sums[n] = sums.get(n, 0.0) + x
        else:
            asked.append((r["bucket"], _un(r["words"], np.uint64), _un(r["learned"], np.uint32), [_un(t, np.uint32) for t in r["tables"]]))
    rows = []
    if asked:
        words, place = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        add = lambda parts: np.bincount(place, weights=np.concatenate(parts), minlength=len(words)).astype(np.int64)
        learned = add([a[2] for a in asked])
        sums |= {_N: float(learned.sum()), _V: float((learned > 0).sum())}
        one, states = np.zeros(len(words), dtype=np.int64), []
        base = np.full(len(words), 1 / (int((learned > 0).sum()) + 1))
        rng = np.random.default_rng([2, int(words[0])])
        for s in range(SAMPLES):
            customers = add([a[3][s] for a in asked])
            seating = Seating(customers, one, 1, rng)
            for _ in range(BURN_IN + 1):
                seating.sweep(base, ROOT_DISCOUNT, ROOT_STRENGTH)
            states.append((customers, seating.tables()))
            sums |= {_PARENT + 2 * s: float(customers.sum()), _PARENT + 2 * s + 1: float(states[-1][1].sum())}
        ends = np.cumsum([len(a[1]) for a in asked])
        for (bucket, own, _, _), end in zip(asked, ends, strict=True):
            at = place[end - len(own) : end]
            rows.append((bucket, _z(own, np.uint64), _z(learned[at], np.uint32), [_z(c[at], np.uint32) for c, _ in states],
                         [_z(t[at], np.uint32) for _, t in states], None, None))
    rows.append((None, None, None, None, None, list(sums), list(sums.values())))
    return _table(rows, _TOLD_TYPES)


_ANSWER = "block string, bucket int, n_learned long, n_known long, word_learned binary, cost binary"
_ANSWER_TYPES = [
    ("block", pa.string()), ("bucket", pa.int32()), ("n_learned", pa.int64()), ("n_known", pa.int64()),
    ("word_learned", pa.binary()), ("cost", pa.binary()),
]


def _answered(hot, buckets):
    """Probabilities of a bucket's pairs, for every block that sent them."""
    hot_at = _PARENT + 2 * SAMPLES

    def run(sent: pa.Table, told: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return pa.table([pa.array([], t) for _, t in _ANSWER_TYPES], names=[n for n, _ in _ANSWER_TYPES])
        number = sent["bucket"][0].as_py()
        contexts, words, learned, blocks = _bucket(sent)
        sums, known = {}, []
        for r in told.to_pylist():
            if r["names"] is not None:
                sums = dict(zip(r["names"], r["amounts"], strict=True))
            else:
                states = [(_un(c, np.uint32), _un(t, np.uint32)) for c, t in zip(r["customers"], r["tables"], strict=True)]
                known.append((_un(r["words"], np.uint64), _un(r["learned"], np.uint32), states))
        names = np.concatenate([k[0] for k in known])
        order = np.argsort(names)
        word = order[np.searchsorted(names[order], words)]
        count = np.concatenate([k[1] for k in known])[word]
        n, v = int(sums[_N]), int(sums[_V])
        discount, strength = GRID[max(range(len(GRID)), key=lambda g: sums[g])]
        rooms, room, room_customers = _rooms(contexts, learned)
        frequent = np.flatnonzero(np.isin(rooms, hot))
        where = hot_at + np.searchsorted(hot, rooms[frequent]) * (1 + SAMPLES)
        room_customers[frequent] = [sums.get(k, 0.0) for k in where.tolist()]
        elsewhere = np.zeros(len(rooms))  # a frequent context's words are dealt evenly, and so are its tables
        elsewhere[frequent] = [sums.get(k + 1, 0.0) * (1 - 1 / buckets) for k in where.tolist()]
        seating = Seating(learned, room, len(rooms), np.random.default_rng([3, number]), elsewhere)
        total = np.zeros(len(words))
        for s in range(SAMPLES):
            c, t = (np.concatenate([k[2][s][i] for k in known])[word].astype(np.float64) for i in (0, 1))
            customers, tables = sums[_PARENT + 2 * s], sums[_PARENT + 2 * s + 1]
            base = predictive(c, t, 1 / (v + 1), customers, tables, ROOT_DISCOUNT, ROOT_STRENGTH)
            for _ in range(BURN_IN if s == 0 else 1):
                seating.sweep(base, discount, strength)
            there = seating.per_room()
            there[frequent] = [sums.get(k + 1 + s, 0.0) for k in where.tolist()]
            total += predictive(learned, seating.tables(), base, room_customers[room], there[room], discount, strength)
        cost = np.round(np.log10(total / SAMPLES) * -FINE)
        rows = [(b, number, n, v, _z(count[at], np.uint32), _z(cost[at], np.uint32)) for b, at in blocks]
        return _table(rows, _ANSWER_TYPES)

    return run


_SCORES = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(id_type):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        count = np.concatenate([_un(x.as_py(), np.uint32) for x in answers["word_learned"]])
        log10 = np.concatenate([_un(x.as_py(), np.uint32) for x in answers["cost"]]) / -FINE
        n, v = answers["n_learned"][0].as_py(), answers["n_known"][0].as_py()
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        tables = []
        for r in blocks.to_pylist():
            sizes = np.array(r["sizes"], dtype=np.int64)
            place = np.cumsum(_un(r["steps"], np.int32).astype(np.int64))
            if len(place) and place.max() >= len(count):
                raise RuntimeError("the documents were read in other blocks than before; write them to a table first")
            doc = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda values: np.bincount(doc, weights=values[place], minlength=len(sizes))  # noqa: E731, B023
            tables.append(pa.table(
                [pa.array(r["ids"], id_type), pa.array(r["held_out"]), pa.array(sizes), pa.array(add(count > 0).astype(np.int64)),
                 pa.array(np.full(len(sizes), n)), pa.array(add(base)), pa.array(add(log10))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ))
        return pa.concat_tables(tables)

    return run


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words in lower case (A-Z only) and one end. The model
    learns from every row that is not held out; ``score`` is its log10
    probability of the text, ``base_score`` that of smoothed word counts.
    Null is the empty text, which has its end token; a null id is learned
    from. Equal rows are each learned and scored. The corpus is read twice within the plan and must come
    in the same partitions, as files do. Reads it once when called, for its
    size and its frequent contexts. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = documents_of(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    often = stored(source.mapInArrow(_frequent, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")), "frequent-contexts")
    total = often.agg(F.sum(F.when(F.col("context").isNull(), F.col("n")))).first()[0] or 0
    found = often.where(F.col("context").isNotNull() & (F.col("n") * HOT_SHARE >= total)).select("context").collect()  # HOT_SHARE rows at most
    drop_stored(often)
    hot = np.sort(np.array([r["context"] for r in found], dtype=np.int64).view(np.uint64))
    buckets = max(LEAST_BUCKETS, math.ceil(total / bucket_tokens))
    sent = source.mapInArrow(_sender(hot, buckets), _SENT)
    held = source.mapInArrow(
        _documents(hot, buckets, id_type), f"block string, ids array<{kind.simpleString()}>, held_out array<boolean>, sizes array<long>, steps binary"
    )
    asked = sent.groupBy("bucket").applyInArrow(_first_seating(hot, buckets), _WORDS)
    parent = asked.groupBy("slot").applyInArrow(_parent, _TOLD)
    sums = parent.where("names IS NOT NULL").select(F.explode(F.map_from_arrays("names", "amounts")).alias("name", "amount"))
    sums = sums.groupBy("name").agg(F.sum("amount").alias("amount")).agg(F.collect_list("name").alias("names"), F.collect_list("amount").alias("amounts"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("words", "binary"), ("learned", "binary"), ("customers", "array<binary>"), ("tables", "array<binary>"))]
    everywhere = sums.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), *nothing, "names", "amounts")
    told = parent.where("names IS NULL").unionByName(everywhere).withColumnRenamed("bucket", "to_bucket")
    answers = sent.groupBy("bucket").cogroup(told.groupBy("to_bucket")).applyInArrow(_answered(hot, buckets), _ANSWER)
    answers = answers.withColumnRenamed("block", "of_block")
    out = held.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_scored(id_type), _SCORES.format(kind.simpleString()))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
