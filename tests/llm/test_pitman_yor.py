"""The Pitman-Yor model: counts and base score against plain ones, seating and probabilities against a plain sampler."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dawnchorus.llm import pitman_yor as py

SCHEMA = "doc_id long, text string, block string, bucket int, words string, score double, context string"


def chain_texts(n, seed=2):
    """Texts in which a word follows from the one before."""
    rng = random.Random(seed)
    follows = {i: [rng.randrange(40) for _ in range(3)] for i in range(40)}
    texts = []
    for _ in range(n):
        w = [rng.randrange(40)]
        for _ in range(rng.randrange(30)):
            w.append(rng.choice(follows[w[-1] % 40]) if rng.random() < 0.9 else rng.randrange(400))
        texts.append(" ".join(f"w{x}" for x in w))
    return texts


def odd_rows():
    texts = [None, "", " \t\n", "One TWO one", "É é", "the " * 400, *chain_texts(150), "unseen words only here"]
    rows = [(i if i != 9 else None, t, "b", 1, "w", 0.5, "c") for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12]]


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def found(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(folder)
    return py.scores(spark.read.parquet(folder)).collect()


def test_counts_and_base_score(rows, found):
    c = Counter(t for r in rows if not out(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        ts = tokens(r[1])
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want.append((str(r[0]), out(r[0]), len(ts), sum(c[t] > 0 for t in ts), n, round(base, 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found]
    assert sorted(got) == sorted(want)


def plain_model(rows, sweeps=60, samples=40, discount=0.75, strength=30.0, seed=1):
    """One customer at a time, all restaurants at once; averaged log10 probabilities of the rows."""
    rng = random.Random(seed)
    seats, totals = defaultdict(lambda: defaultdict(list)), Counter()
    pairs = [(u, w) for r in rows if not out(r[0]) for u, w in zip(["<", *tokens(r[1])], tokens(r[1]), strict=False)]
    root, v = defaultdict(list), len({w for _, w in pairs})
    d0, s0 = py.ROOT_DISCOUNT, py.ROOT_STRENGTH
    count = {"customers": 0, "tables": 0}

    def root_p(w):
        held = root.get(w, [])
        return (max(sum(held) - d0 * len(held), 0) + (s0 + d0 * count["tables"]) / (v + 1)) / (s0 + count["customers"])

    def add(held, weight_new, d):
        weights = [x - d for x in held]
        x = rng.random() * (sum(weights) + weight_new)
        for i, y in enumerate(weights):
            x -= y
            if x < 0:
                held[i] += 1
                return False
        held.append(1)
        return True

    def take(held):
        x = rng.randrange(sum(held))
        for i, y in enumerate(held):
            x -= y
            if x < 0:
                held[i] -= 1
                if not held[i]:
                    del held[i]
                    return True
                return False

    tables = Counter()

    def seat(u, w):
        totals[u] += 1
        if add(seats[u][w], (strength + discount * tables[u]) * root_p(w), discount):
            tables[u] += 1
            count["customers"] += 1
            if add(root[w], (s0 + d0 * count["tables"]) / (v + 1), d0):
                count["tables"] += 1

    def leave(u, w):
        totals[u] -= 1
        if take(seats[u][w]):
            tables[u] -= 1
            count["customers"] -= 1
            if take(root[w]):
                count["tables"] -= 1

    for u, w in pairs:
        seat(u, w)
    asked = {(u, w) for r in rows for u, w in zip(["<", *tokens(r[1])], tokens(r[1]), strict=False)}
    total = Counter()
    for k in range(sweeps + samples):
        for u, w in pairs:
            leave(u, w)
            seat(u, w)
        if k >= sweeps:
            for u, w in asked:
                held = seats[u].get(w, []) if u in seats else []
                own = sum(held) - discount * len(held)
                total[u, w] += (own + (strength + discount * tables[u]) * root_p(w)) / (strength + totals[u])
    return [sum(math.log10(total[u, w] / samples) for u, w in zip(["<", *tokens(r[1])], tokens(r[1]), strict=False)) for r in rows]


def test_scores_follow_a_plain_sampler(rows):
    want = plain_model(rows)
    got = local_scores(*local_state(rows), rows)
    per_token = [abs(a - b) / len(tokens(r[1])) for a, b, r in zip(got, want, rows, strict=True)]
    assert np.mean(per_token) < 0.02 and max(per_token) < 0.12


def local_state(rows):
    pairs = Counter((u, w) for r in rows if not out(r[0]) for u, w in zip(["<", *tokens(r[1])], tokens(r[1]), strict=False))
    for r in rows:
        for p in zip(["<", *tokens(r[1])], tokens(r[1]), strict=False):
            pairs.setdefault(p, 0)
    keys = list(pairs)
    names = {w: i for i, w in enumerate({w for _, w in keys})}
    rooms = {u: i for i, u in enumerate({u for u, _ in keys})}
    return pairs, names, rooms


def local_scores(pairs, names, rooms, rows, samples=20):
    """The module's seating and probabilities, alternating contexts and parent, without Spark."""
    keys = list(pairs)
    customers = np.array([pairs[k] for k in keys])
    word, room = (np.array([m[k[i]] for k in keys]) for m, i in ((names, 1), (rooms, 0)))
    count = np.bincount(word, weights=customers)
    v, rng = int((count > 0).sum()), np.random.default_rng(4)
    base = ((count + 0.5) / (count.sum() + 0.5 * (v + 1)))[word]
    seating = py.Seating(customers, room, len(rooms), rng)
    total = np.zeros(len(keys))
    for k in range(30 + samples):
        seating.sweep(base, 0.75, 30.0)
        tables = seating.tables()
        at_root = np.bincount(word, weights=tables, minlength=len(names)).astype(np.int64)
        parent = py.Seating(at_root, np.zeros(len(names), dtype=np.int64), 1, rng)
        for _ in range(4):
            parent.sweep(np.full(len(names), 1 / (v + 1)), py.ROOT_DISCOUNT, py.ROOT_STRENGTH)
        held = parent.tables()
        base = py.predictive(at_root, held, 1 / (v + 1), at_root.sum(), held.sum(), py.ROOT_DISCOUNT, py.ROOT_STRENGTH)[word]
        if k >= 30:
            full = np.bincount(room, weights=customers, minlength=len(rooms))
            total += py.predictive(customers, tables, base, full[room], seating.per_room()[room], 0.75, 30.0)
    at = {k: i for i, k in enumerate(keys)}
    return [sum(math.log10(total[at[p]] / samples) for p in zip(["<", *tokens(r[1])], tokens(r[1]), strict=False)) for r in rows]


def test_model_beats_word_counts_on_held_out_texts(found):
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 5]
    assert len(held) > 10
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in found)


def test_the_same_again_in_smaller_buckets(spark, rows, found, tmp_path):
    folder = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(folder)
    again = {str(r["doc_id"]): r for r in py.scores(spark.read.parquet(folder), bucket_tokens=50).collect()}
    for r in found:
        other = again[str(r["doc_id"])]
        assert r["n_known"] == other["n_known"] and r["train_tokens"] == other["train_tokens"]
        assert abs(r["score"] - other["score"]) < 0.15 * r["n_tokens"]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(7)
    customers = rng.integers(0, 9, 300)
    room = np.zeros(300, dtype=np.int64)
    seating = py.Seating(customers, room, 1, rng)
    base = rng.dirichlet(np.ones(301))[:300]
    for _ in range(20):
        seating.sweep(base, 0.6, 5.0)
    t = seating.tables()
    assert ((t <= customers) & ((t > 0) == (customers > 0))).all()
    sizes = np.bincount(seating.owner, weights=seating.size, minlength=len(seating.many))
    assert (sizes == customers[seating.many]).all()
    p = py.predictive(customers, t, base, customers.sum(), t.sum(), 0.6, 5.0)
    rest = (5.0 + 0.6 * t.sum()) * (1 - base.sum()) / (5.0 + customers.sum())
    assert abs(p.sum() + rest - 1) < 1e-9


def test_a_sweep_takes_up_every_customer():
    n, base, d, s = 3000, 0.3, 0.75, 1000.0
    rng, held = random.Random(3), [3000]
    for _ in range(4 * n):  # one customer at a time
        x = rng.randrange(n)
        k = int(np.searchsorted(np.cumsum(held), x, "right"))
        held[k] -= 1
        if not held[k]:
            del held[k]
        new, old = (s + d * len(held)) * base, n - 1 - d * len(held)
        if rng.random() * (new + old) < new:
            held.append(1)
        else:
            held[rng.choices(range(len(held)), [y - d for y in held])[0]] += 1
    got = []
    for seed in range(5):
        seating = py.Seating(np.array([n]), np.zeros(1, dtype=np.int64), 1, np.random.default_rng(seed))
        for _ in range(4):
            seating.sweep(np.array([base]), d, s)
        assert seating.size.sum() == n and (seating.size > 0).all()
        got.append(len(seating.size))
    assert abs(np.mean(got) / len(held) - 1) < 0.35, (got, len(held))


class CountingDraws:
    """A generator that counts the numbers it drew."""

    def __init__(self, seed):
        self.rng, self.drawn = np.random.default_rng(seed), 0

    def __getattr__(self, name):
        def draw(*args):
            out = getattr(self.rng, name)(*args)
            self.drawn += np.size(out)
            return out

        return draw


def test_a_sweep_looks_at_the_words_of_its_customers_only():
    customers = np.random.default_rng(5).integers(2, 6, 5000)
    room, rng = np.arange(5000) % 700, CountingDraws(6)
    seating = py.Seating(customers, room, 700, rng)
    for _ in range(3):
        rng.drawn = 0
        seating.sweep(np.full(5000, 1e-3), 0.75, 10.0)
        assert rng.drawn <= 3 * customers.sum()  # a round, whether a table opens, and the table to join
        assert (np.bincount(seating.owner, weights=seating.size, minlength=5000) == customers).all()
        assert (seating.size > 0).all() and (np.diff(seating.owner) >= 0).all()


def test_a_sweep_holds_no_array_of_all_customers():
    n = 4_000_000
    seating = py.Seating(np.array([n, 3, 900]), np.zeros(3, dtype=np.int64), 1, np.random.default_rng(1))
    tracemalloc.start()
    try:
        for _ in range(2):
            seating.sweep(np.array([0.3, 0.1, 0.2]), 0.75, 1000.0)
        assert tracemalloc.get_traced_memory()[1] < 8 * n
    finally:
        tracemalloc.stop()
    assert np.bincount(seating.owner, weights=seating.size).tolist() == [n, 3, 900]
    assert len(seating.size) > 400


def test_few_customers_sit_as_one_at_a_time():
    words, d, s, base = 6000, 0.75, 10.0, 0.02
    customers, room = np.tile([2, 3, 4], words // 3), np.arange(words) // 3
    got, want = [], []
    seating = py.Seating(customers, room, words // 3, np.random.default_rng(8))
    rng, held, rooms = random.Random(9), [[int(c)] for c in customers], [3] * (words // 3)
    for k in range(6):
        seating.sweep(np.full(words, base), d, s)
        for w in range(words):
            for _ in range(customers[w]):
                x = rng.choices(range(len(held[w])), held[w])[0]
                held[w][x] -= 1
                if not held[w][x]:
                    del held[w][x]
                    rooms[room[w]] -= 1
                weights = [y - d for y in held[w]] + [(s + d * rooms[room[w]]) * base]
                x = rng.choices(range(len(weights)), weights)[0]
                if x == len(held[w]):
                    held[w].append(0)
                    rooms[room[w]] += 1
                held[w][x] += 1
        if k >= 3:
            got.append([seating.tables()[customers == c].mean() for c in (2, 3, 4)])
            want.append([np.mean([len(h) for h, n in zip(held, customers, strict=True) if n == c]) for c in (2, 3, 4)])
    assert np.abs(np.mean(got, axis=0) / np.mean(want, axis=0) - 1).max() < 0.04, (got, want)


def test_pairs_of_a_block_are_numbered_by_bucket_and_context():
    rows = [(k, x) for k, x in enumerate(chain_texts(60))]
    batch = py.pa.RecordBatch.from_arrays([py.pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "text"])
    hot = np.sort(next(py._tokens(batch))[2][:3])
    (ids, _, sizes, place, contexts, words, learned, bucket), *more = py._blocks(iter([batch]), hot, 5)
    assert ids == [k for k, _ in rows] and not more and set(bucket.tolist()) == set(range(5))
    assert (np.diff(bucket) >= 0).all() and (bucket == py._dealt(contexts, words, hot, 5)).all()
    seen = [c for b, low, high in py._groups(bucket) for c in py._runs(contexts[low:high])[0].tolist()]
    assert len(seen) == len({(int(b), int(c)) for b, c in zip(bucket, contexts, strict=True)})
    tokens_, before = (np.concatenate([x[k] for x in py._tokens(batch)]) for k in (2, 3))
    assert (words[place] == tokens_).all() and (contexts[place] == before).all()
    trained = np.bincount(place, weights=np.repeat([not out(i) for i in ids], sizes), minlength=len(words))
    assert (learned == trained).all() and len(words) == len(set(zip(contexts.tolist(), words.tolist(), strict=True)))


def test_empty_table(spark):
    assert py.scores(spark.createDataFrame([], SCHEMA)).count() == 0
