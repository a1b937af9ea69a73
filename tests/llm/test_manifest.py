"""The Merkle manifest against a plain tree, on odd rows, one source, many sources, one hot source."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from dawnchorus.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, digest string, n string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root of a run of nodes, and per node its steps (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // 16 * 16
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 16])))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((leaf(r, r[4]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        held = sorted(by_source[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append((held, *climb([x[0] for x in held])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (held, subroot, paths), top in zip(trees, tops, strict=True):
        for (digest, r), path in zip(held, paths, strict=True):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r, text)
            for before, after in path + top:
                fold = sha(before + fold + after)
            proof = sha("".join(b + a for b, a in path + top))
            out.append((r[0], digest, subroot, root, proof, fold, fold == root))
    return sorted(out, key=str)


def result(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 1, "d", "n") for r in rows], SCHEMA).repartition(3)
    got = manifest.verified(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r) for r in got.collect()], key=str)


def odd():
    rows = [(i, "hot", ("en", None)[i % 2], i, f"Text {i} É") for i in range(300)]
    rows += [(i, f"s{i % 21}", "de", None, ("A", "", None, "lower")[i % 4]) for i in range(300, 420)]
    rows += [(None, None, None, None, None), (7, None, "x", 1, "B" * 40_000), (7, "hot", "en", 1, "Tie"), (7, "hot", "en", 1, "Tie")]
    return rows + [(500, "", "en", 2, "Blank source"), (501, "ä", "en", 2, "Last"), (502, "lone", "en", 2, "LONE")]


@pytest.mark.parametrize("rows", [odd(), [(5, "a", "en", 1, "Only")], [(i, "a", None, i, "ONE source") for i in range(17)]])
def test_equals_a_plain_tree(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_a_changed_row_changes_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "t") for i in range(40)]
    before = result(spark, rows)[0][3]
    rows[11] = (*rows[11][:4], "u")
    assert result(spark, rows)[0][3] != before


def test_equal_rows_share_no_task_of_one_tree(spark):
    """Copies of one row are one row until they get their places."""
    rows = spark.range(3000).select(F.lit("").alias("tree"), F.lit(1).alias("doc_id"), F.lit(b"x").alias("digest"))
    counted = rows.groupBy("tree", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    got = manifest.ranked(counted, ["doc_id", "digest"], "copies").first()
    assert (got["idx"], got["n"], got["copies"]) == (0, 3000, 3000)
