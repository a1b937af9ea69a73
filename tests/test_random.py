"""Operators against plain-Python models on random, awkward inputs."""

import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from dawnchorus.functions import text as t
from dawnchorus.operators import classify, labels, routing
from dawnchorus.sources.audio_tree import glob_regex

N = 1500


def strings(seed, alphabet, longest, n=N):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def rows(spark, values, *columns):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()


def test_paths(spark):
    s = F.col("s")
    values = [v for v in strings(1, "ab./ \n", 8) if not v.startswith("/")]
    got = rows(spark, values, t.clean_path(s), t.base_name(s), t.parent_path(s), t.file_stem(s), t.file_suffix(s), t.path_depth(s), t.first_folder(s))
    for v, r in zip(values, got):
        p = PurePosixPath(v)
        parent = "" if str(p.parent) == "." else str(p.parent)
        whole = "" if str(p) == "." else str(p)
        first = p.parts[0] if len(p.parts) > 1 else None
        assert tuple(r)[1:] == (whole, p.name, parent, p.stem, p.suffix, len(p.parts), first), repr(v)


def test_destinations(spark):
    templates = ["{parents}/{filestem}{ext}", "{filestem}", "x/{parents}/{analysis}.v1", "{parents}{ext}{filestem}"]
    values = [v for v in strings(2, "ab./\\", 7) if not v.startswith("/")]

    def model(template, source):
        p = PurePosixPath(source)
        parent = "" if str(p.parent) == "." else str(p.parent)
        known = {"parents": parent, "filestem": p.stem, "ext": ".csv", "analysis": "classify_results"}
        out = re.sub(r"\{(\w+)\}", lambda m: known[m.group(1)], template)
        out = re.sub("/+", "/", out.replace("\\", "/")).lstrip("/")
        if PurePosixPath(out).suffix != ".csv":
            out += ".csv"
        return str(PurePosixPath(out))

    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        columns = [routing.destination(F.col("s"), x, "classify", "csv") for x in templates]
    for v, r in zip(values, rows(spark, values, *columns)):
        assert list(r)[1:] == [model(x, v) for x in templates], repr(v)


def test_lists_and_candidates(spark):
    values = strings(3, "aB_, \n\t  ", 10)
    got = rows(spark, values, t.split_items(F.col("s")), t.normalized_items(F.col("s")), t.candidate_labels(F.col("s")))
    for v, r in zip(values, got):
        items = [x.strip() for x in re.split(r"[\n,]", v) if x.strip()]
        whole = v.strip()
        parts = [whole] + ([x.strip() for x in whole.split("_", 1)] if "_" in whole else [])
        assert r["c0"] == items, repr(v)
        assert r["c1"] == sorted({x.lower() for x in items}), repr(v)
        assert r["c2"] == list(dict.fromkeys(x for x in parts if x)), repr(v)


def test_globs(spark):
    import fnmatch

    values = strings(4, "ab.[]^", 5, 300)
    for glob in ("*", "a*", "?b", "[ab]*", "[!a]*", "*.[ab]", "[^a]b", "a[]]", "[[]*", "a.b"):
        got = rows(spark, values, F.col("s").rlike(glob_regex(glob)))
        want = re.compile(fnmatch.translate(glob))
        for v, r in zip(values, got):
            assert r["c0"] == bool(want.match(v)), (glob, v)


def pool(rng, n):
    return ["".join(rng.choice("aAbB") for _ in range(rng.randint(1, 3))) for _ in range(n)]


def entries(rng, n=250):
    return [rng.choice(["{}_{}", "{}", " {}_ {}_x", "_{}"]).format(*pool(rng, 2)) for _ in range(n)]


def label_candidates(raw):
    whole = raw.strip()
    parts = [whole] + ([x.strip() for x in whole.split("_", 1)] if "_" in whole else [])
    return list(dict.fromkeys(x for x in parts if x))


@pytest.mark.parametrize("seed", [5, 6])
def test_code_first(spark, seed):
    rng = random.Random(seed)
    codes, pairs, raw = set(pool(rng, 12)), [(x, f"code{i}") for i, x in enumerate(pool(rng, 30))], entries(rng)
    items = spark.createDataFrame(list(enumerate(raw)), "item_ord int, raw string")
    found = labels.translate_code_first(
        items,
        spark.createDataFrame([(c,) for c in codes], "label string"),
        spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "ord int, src string, dst string"),
    )
    known = dict(pairs)

    def model(x):
        cands = label_candidates(x)
        hits = [c for c in cands if c in codes] + [known[c.lower()] for c in cands if c.lower() in known]
        return hits[0] if hits else None

    assert {r["raw"]: r["label"] for r in found.collect()} == {x: model(x) for x in raw}
    want = list(dict.fromkeys(model(x) for x in raw if model(x)))
    assert [r["label"] for r in labels.translated_list(items, found).orderBy("item_ord").collect()] == want
    missed = [r["raw"] for r in labels.unmatched(items, found).orderBy("item_ord").collect()]
    assert missed == [x for x in raw if model(x) is None]


@pytest.mark.parametrize("seed", [7, 8])
def test_name_first(spark, seed):
    rng = random.Random(seed)
    valid, raw = list(dict.fromkeys(pool(rng, 10))), entries(rng)
    maps = {f"m{k}": dict(zip(pool(rng, 15), pool(rng, 15))) for k in (2, 0, 1)}
    items = spark.createDataFrame(list(enumerate(raw)), "item_ord int, raw string")
    found = labels.translate_name_first(
        items,
        spark.createDataFrame(list(enumerate(valid)), "ord int, label string"),
        spark.createDataFrame(
            [(m, "t", i, a, z) for m, d in maps.items() for i, (a, z) in enumerate(d.items())]
            + [("a_first", "elsewhere", 0, "a", valid[0])],
            "mapping string, target_namespace string, ord int, src string, dst string",
        ),
        "t",
    )
    low = {v.lower(): v for v in valid}

    def accepted(name):
        return name if name in valid else low.get(name.lower())

    def model(x):
        for c in label_candidates(x):
            if accepted(c):
                return accepted(c)
            for m in sorted(maps):
                target = maps[m].get(c, maps[m].get(c.lower()))
                if target is not None and accepted(target):
                    return accepted(target)
        return None

    assert {r["raw"]: r["label"] for r in found.collect()} == {x: model(x) for x in raw}


def test_class_names(spark):
    rng = random.Random(9)
    names = list(dict.fromkeys(pool(rng, 40)))
    to_code = dict(zip(pool(rng, 20), pool(rng, 20)))
    to_name = dict(zip(pool(rng, 20), [rng.choice(["", f"name {i}"]) for i in range(20)]))

    def table(d):
        return spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(d.items())], "ord int, src string, dst string")

    classes = spark.createDataFrame(list(enumerate(names)), "class_idx int, label string")
    got = classify.resolve_class_names(classes, table(to_name), table(to_code)).orderBy("class_idx").collect()
    want = []
    for n in names:
        code = to_code.get(n, n)
        want.append(to_name.get(code) or to_name.get(n) or code)
    assert [r["label"] for r in got] == want
