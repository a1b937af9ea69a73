import pytest
from pyspark.sql import functions as F

from dawnchorus.functions.text import candidate_labels
from dawnchorus.operators import labels as l
from dawnchorus.sources.tables import label_file


def listed(spark, *raw):
    return spark.createDataFrame(list(enumerate(raw)), "item_ord long, raw string")


def ordered(df):
    return [r["label"] for r in df.orderBy("item_ord").collect()]


@pytest.fixture(scope="module")
def taxonomy(spark):
    codes = spark.createDataFrame([("comcuc",), ("souboo8",)], "label string")
    names = spark.createDataFrame(
        [(0, "cuculus canorus", "comcuc"), (1, "ninox boobook", "souboo8")], "ord int, src string, dst string"
    )
    valid = spark.createDataFrame(
        [(0, "Phascolarctos cinereus"), (1, "Cuculus canorus"), (2, "Ninox boobook"), (3, "Ardea ibis")],
        "ord int, label string",
    )
    maps = spark.createDataFrame(
        [
            ("b_map", "inat", 0, "bubulcus ibis", "ardea ibis"),
            ("a_map", "inat", 1, "bubulcus ibis", "not a label"),
            ("c_map", "other", 2, "Unknown thing", "Ardea ibis"),
        ],
        "mapping string, target_namespace string, ord int, src string, dst string",
    )
    return codes, names, valid, maps


def test_candidates(spark):
    df = spark.createDataFrame([(" koala_ Phascolarctos cinereus ",), ("a_b_c",), ("x",), ("_y",), ("z_",), ("q_q",), ("  ",)], "t string")
    got = [r[0] for r in df.select(candidate_labels(F.col("t"))).collect()]
    assert got == [
        ["koala_ Phascolarctos cinereus", "koala", "Phascolarctos cinereus"],
        ["a_b_c", "a", "b_c"],
        ["x"],
        ["_y", "y"],
        ["z_", "z"],
        ["q_q", "q"],
        [],
    ]


def test_name_first(spark, taxonomy):
    _, _, valid, maps = taxonomy
    items = listed(
        spark, "koala_Phascolarctos cinereus", "common cuckoo_Cuculus canorus", "Ninox boobook_Morepork",
        "Bubulcus ibis_Cattle Egret", "Bubulcus ibis", "Unknown thing", "NINOX BOOBOOK",
    )
    found = l.translate_name_first(items, valid, maps, "inat")
    assert ordered(l.translated_list(items, found)) == [
        "Phascolarctos cinereus", "Cuculus canorus", "Ninox boobook", "Ardea ibis"
    ]
    assert [r["raw"] for r in l.unmatched(items, found).collect()] == ["Unknown thing"]


def test_code_first(spark, taxonomy):
    codes, names, _, _ = taxonomy
    items = listed(spark, "Cuculus canorus", "Ninox boobook", "Ninox boobook_comcuc", "none")
    found = l.translate_code_first(items, codes, names)
    by_raw = {r["raw"]: r["label"] for r in found.collect()}
    assert by_raw == {
        "Cuculus canorus": "comcuc", "Ninox boobook": "souboo8", "Ninox boobook_comcuc": "comcuc", "none": None
    }
    assert ordered(l.translated_list(items, found)) == ["comcuc", "souboo8"]


def test_nothing_matched(spark, taxonomy):
    codes, names, valid, maps = taxonomy
    items = listed(spark, "not_a_real_species_foo")
    with pytest.raises(ValueError, match="no list entry"):
        l.require_any(l.translate_name_first(items, valid, maps), "names")
    l.require_any(l.translate_code_first(listed(spark, "x").limit(0), codes, names), "codes")


def test_canonical_names(spark):
    allowed = spark.createDataFrame(
        [(0, "abavorana luctuosa"), (1, " Abavorana luctuosa "), (2, "Abeillia abeillei"), (3, "")], "ord int, label string"
    )
    items = listed(spark, "abavorana luctuosa", "ABAVORANA LUCTUOSA", " abeillia abeillei")
    matched = l.canonicalize(items, allowed)
    assert ordered(l.canonical_list(matched)) == ["Abavorana luctuosa", "Abeillia abeillei"]
    l.require_all_known(matched, "names")
    with pytest.raises(ValueError, match="'nope', 'zero'"):
        l.require_all_known(l.canonicalize(listed(spark, " nope ", "abeillia abeillei", "zero"), allowed), "names")


def test_split_keeps_first_positions_and_case(spark):
    items = listed(spark, "B, a\nB ,,\t c ", "a\r\nD")
    got = l.split_list(items).orderBy("item_ord", "pos").collect()
    assert [r["value"] for r in got] == ["B", "a", "c", "D"]
    assert [r["item_ord"] for r in got] == [0, 0, 0, 1]
    low = l.normalize_lists(items).orderBy("item_ord").collect()
    assert [r["items"] for r in low] == [["a", "b", "c"], ["a", "d"]]


def test_label_file_keeps_line_order(spark, tmp_path):
    path = tmp_path / "species.txt"
    names = [f"Genus{i} species_Common {i}" for i in range(500)]
    path.write_text("\n".join(names) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        df = label_file(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        got = [r["raw"] for r in df.orderBy("item_ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == names


def test_many_copies_of_one_label(spark, taxonomy):
    codes, names, _, _ = taxonomy
    facts = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "Cuculus canorus").otherwise(F.concat(F.lit("x_"), F.col("id").cast("string"))).alias("raw"),
        F.col("id").alias("item_ord"),
    )
    found = l.translate_code_first(facts, codes, names)
    out = l.harmonize(facts, "raw", found)
    assert out.count() == 30_000 and out.where("label = 'comcuc'").count() == 10_000
