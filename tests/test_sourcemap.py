"""Published sources: every rule on a small set of invented recorder names."""

import pytest
from pyspark.sql import functions as F

from dawnchorus.functions.patterns import NamePattern
from dawnchorus.operators import sourcemap as m
from dawnchorus.operators.sourcemap import SOURCE_TEMPLATES, SourceMap

# unit, night and take of a recorder: U7_n012_t3.wav
TAKE = r"^U(?P<unit>\d)_n(?P<night>\d+)(?:_t(?P<take>\d+))?\.wav$"
FULL, SHORT, ODD = "marsh/U7_n012_t3.wav", "marsh/U7_n013.wav", "marsh/readme.wav"


def sources(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source string")


def mapped(spark, smap, *names):
    df = m.map_sources(sources(spark, *names), smap)
    m.require_mapped(df, smap)
    return {r["source"]: r["mapped_source"] for r in df.collect()}


def metadata(spark, smap, name):
    return sources(spark, name).select(*[c.alias(n) for n, c in smap.metadata(F.col("source")).items()]).first().asDict()


@pytest.mark.parametrize(
    "name, want",
    [
        (FULL, {"night": "012", "take": "3", "unit": "7"}),
        (SHORT, {"night": "013", "take": "1", "unit": "7"}),
        (ODD, {"night": None, "take": "1", "unit": None}),
    ],
)
def test_a_group_that_matched_wins_over_the_static_value(spark, name, want):
    assert metadata(spark, SourceMap(static={"take": 1}, pattern=TAKE), name) == want


def test_the_canonical_name_splits_at_its_last_number(spark):
    got = metadata(spark, SourceMap(pattern="canonical_filename"), "x/20300102T030405Z_Reed_Bed_2_77.wav.gz")
    assert got == {"timestamp": "20300102T030405Z", "site_name": "Reed_Bed_2", "audio_recording_id": "77", "extension": "wav.gz"}


@pytest.mark.parametrize("name", sorted(SOURCE_TEMPLATES))
def test_every_named_template_renders(spark, name):
    smap = SourceMap(SOURCE_TEMPLATES[name], {"domain": "ftp://reed", "audio_recording_id": 5})
    value = mapped(spark, smap, FULL)[FULL]
    assert value.endswith("/audio_recordings/5/original") and "{" not in value


def test_tokens_come_from_both_sides(spark):
    smap = SourceMap("{bucket}/{unit}-{night}", {"bucket": "gs://b"}, TAKE)
    assert mapped(spark, smap, FULL, SHORT) == {FULL: "gs://b/7-012", SHORT: "gs://b/7-013"}


def test_faults_are_counted_listed_and_reported_in_one_order(spark, tmp_path):
    import re

    smap = SourceMap("{night}", pattern=r"(?P<night>[{}a-z]+)[0-9]*\.wav$")
    missing, braced, twins = ["1.wav", "2.wav", "3.wav"], ["{.wav"], ["k1.wav", "k2.wav"]
    for names, text, n in (
        ([*twins, *braced, *missing], "missing token value for 3 sources", 3),
        ([*twins, *braced], "brace syntax in 1 rendered", 1),
        (twins, "collision: 1 values", 2),
    ):
        with pytest.raises(ValueError, match=text) as e:
            mapped(spark, smap, *names)
        folder = re.search(r"all in (\S+)", str(e.value))[1]
        assert spark.read.parquet(folder).count() == n
    assert mapped(spark, smap, "k1.wav", "m1.wav") == {"k1.wav": "k", "m1.wav": "m"}


def test_values_are_not_scanned_again(spark):
    smap = SourceMap("u/{stem}", pattern=NamePattern.compile(r"^(?P<stem>.+)\.wav$"))
    assert m.map_sources(sources(spark, "{stem}.wav"), smap).first()["mapped_source"] == "u/{stem}"


def test_hot_collision_lists_every_source(spark):
    df = spark.range(9000).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"),
        F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("mapped_source"),
    )
    assert m.collisions(df).count() == 3000
    assert m.collision_summary(df).first()["n_sources"] == 3000


def test_own_functions(spark):
    smap = SourceMap(template=F.upper, extra=lambda c: {"unit": F.substring(c, 8, 1)})
    row = m.map_sources(sources(spark, FULL), smap).first()
    assert (row["mapped_source"], row["unit"]) == (FULL.upper(), "7")
    assert mapped(spark, None, FULL) == {FULL: FULL}
    with pytest.raises(ValueError, match="clash"):
        m.map_sources(sources(spark, FULL), SourceMap(extra=lambda c: {"offset": c}))


def test_extra_columns_are_those_with_a_value(spark):
    smap = SourceMap(static={"region": "north"}, pattern=TAKE)
    df = m.map_sources(sources(spark, SHORT, ODD), smap, ["take", "region", "unit", "absent"])
    assert df.columns == ["source", "mapped_source", "region", "take", "unit"]
    assert m.present_extras(df, ["take", "region", "unit"]) == ["region", "unit"]
    assert m.present_extras(df.where(F.col("source") == ODD), ["take", "region", "unit"]) == ["region"]


@pytest.mark.parametrize(
    "smap, text",
    [
        (SourceMap("{unit}/{moon}", pattern=TAKE), "no value for template tokens ..moon"),
        (SourceMap("{unit}", pattern="(?P<unit>"), "invalid file-name pattern"),
        (SourceMap(" "), "empty"),
    ],
)
def test_a_bad_definition_fails_with_the_plan(spark, smap, text):
    with pytest.raises(ValueError, match=text):
        m.map_sources(sources(spark, FULL), smap)


def test_a_fixed_template_is_for_one_file(spark):
    m.require_pattern_for_many(1, SourceMap("fixed"))
    with pytest.raises(ValueError, match="without a pattern"):
        m.require_pattern_for_many(2, SourceMap("fixed"))


PATTERNS = [
    r"^(?P<id>\d+)(?:\.(?P<ext>\w+))?",
    r"(?P<a_b>x|y+)-(?P<c>\d{2,3})?",
    r"(?P<empty>\d*)(?P<rest>.*)",
    r"(?P<q>a)(?P=q)",
    r"[(?P<id>]+(?P<n>\d)",
    r"(?i)(?P<w>ABC)$",
    r"\(?P<x>(?P<real>z)",
    r"^(?P<u>\w+) (?P<d>\d+)$",
    r"(?P<tail>.)\Z",
    r"(?P<cls>[[a]b])",
    r"(?P<word>\w+)",
    r"(?P<word>[\w-]+)(?P<rest>\W)",
    r"(?P<gap>\s)(?P<next>\S)",
    r"(?P<odd>[^\W\d])",
    r"\b(?P<edge>\w)",
    r"(?P<first>[]\w]+)",
]
TEXTS = ["12.wav", "12", "", "x-12", "yyy-", "aa1", "(?P<id>7", "xabc", "xABC\n", "(P<x>z", "ä١ ٣", "q\r\n", "[b]", "ab]", "cafe\u0301_1", "m\u00b2_1", "a\x1fb", "\u216b-", "]x"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_agree_with_python(spark, pattern):
    import re

    compiled = NamePattern.compile(pattern)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = df.select("i", *[c.alias(n) for n, c in compiled.extract(F.col("t")).items()]).orderBy("i").collect()
    for row, text in zip(got, TEXTS):
        found = re.search(pattern, text)
        for name in compiled.names:
            assert row[name] == (found.group(name) if found else None), (pattern, text, name)
