"""Class scores: calibration, threshold, allowed classes, top-N, names, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnchorus.functions.text import window_key
from dawnchorus.operators import classify, labels, publish, store
from dawnchorus.operators.sourcemap import SOURCE_TEMPLATES, SourceMap
from dawnchorus.plans import jobs
from dawnchorus.schemas import RESULTS
from dawnchorus.sizing import scratch_folder, written
from dawnchorus.sources.tables import staged_detections

from . import bindings as b
from .bindings import Registry, with_ctes

registry = Registry()

# Scores of the array form are compared with this threshold, three per window.
THRESHOLD, TOP = -10.0, 3

EXPLODED = """exploded AS (
  SELECT recording_id, window_idx, channel, offset_s, CAST(i AS INTEGER) AS class_idx,
         CAST(embedding[i + 1] AS DOUBLE) * 0.97 - 10 AS score
  FROM (SELECT *, unnest(generate_series(0, len(embedding) - 1)) AS i FROM windows))"""

TOP_ROWS = """top_rows AS (
  SELECT * FROM exploded WHERE score >= -10.0
  QUALIFY row_number() OVER (PARTITION BY recording_id, window_idx, channel
                             ORDER BY score DESC, class_idx DESC) <= 3)"""


def _logit_windows(spark, sf_dir):
    return b.windows(spark, sf_dir).drop("label").withColumnRenamed("embedding", "logits")


@registry.add(
    with_ctes(
        """SELECT source, channel, offset_s AS "offset", label, round(score, 6) AS score
           FROM top_rows JOIN recordings USING (recording_id) JOIN classes USING (class_idx)""",
        b.WINDOWS_SQL, b.RECORDINGS_SQL, b.CLASSES_SQL, EXPLODED, TOP_ROWS,
    )
)
def classify_topn(spark, sf_dir):
    """Best classes per window with source and class name (array logits)."""
    found = classify.top_classes(_logit_windows(spark, sf_dir), "logits", THRESHOLD, TOP)
    named = classify.name_classes(found, b.classes(spark, sf_dir))
    rows = store.windows_by_source(named, b.recordings(spark, sf_dir))
    return rows.select("source", "channel", F.col("offset_s").alias("offset"), "label", b.score6())


@registry.add(
    with_ctes(
        """SELECT recording_id, window_idx, class_idx, round(score, 6) AS score FROM top_rows""",
        b.WINDOWS_SQL, EXPLODED, TOP_ROWS,
    )
)
def classify_topn_exploded(spark, sf_dir):
    """The same selection over exploded logits with a ranking window."""
    long = classify.explode_logits(_logit_windows(spark, sf_dir))
    keys = ["recording_id", "window_idx", "channel"]
    found = classify.top_classes_long(long, keys, THRESHOLD, TOP)
    return found.select("recording_id", "window_idx", "class_idx", b.score6())


@registry.add(
    with_ctes(
        """SELECT recording_id, window_idx, class_idx, round(score, 6) AS score
           FROM exploded""",
        b.WINDOWS_SQL, EXPLODED,
    )
)
def logits_calibrated(spark, sf_dir):
    """Every class of every window with its calibrated score."""
    long = classify.explode_logits(_logit_windows(spark, sf_dir))
    return long.select(
        "recording_id", "window_idx", "class_idx", F.round(classify.calibrate(F.col("logit")), 6).alias("score")
    )


LONG_SCORED = """scored AS (
  SELECT window_id, class_idx, l_partkey, l_linenumber, logit * 0.97 - 10 AS score
  FROM long_logits WHERE logit * 0.97 - 10 >= 0)"""


def _long_top(top, order_from):
    return f"""top_rows AS (
  SELECT * FROM {order_from}
  QUALIFY row_number() OVER (PARTITION BY window_id
    ORDER BY score DESC, class_idx DESC, l_partkey DESC, l_linenumber DESC) <= {top})"""


@registry.add(
    with_ctes(
        "SELECT window_id, label, round(score, 6) AS score FROM top_rows JOIN long_classes USING (class_idx)",
        b.LONG_LOGITS_SQL, b.LONG_CLASSES_SQL, LONG_SCORED, _long_top(3, "scored"),
    )
)
def classify_topn_long(spark, sf_dir):
    """Best classes per window from logits in long form."""
    found = classify.top_classes_long(
        b.long_logits(spark, sf_dir), ["window_id"], 0.0, 3, tie_keys=("l_partkey", "l_linenumber")
    )
    named = classify.name_classes(found, b.long_classes(spark, sf_dir))
    return named.select("window_id", "label", b.score6())


@registry.add(
    with_ctes(
        "SELECT window_id, class_idx, l_partkey, l_linenumber, round(score, 6) AS score FROM scored",
        b.LONG_LOGITS_SQL, LONG_SCORED,
    )
)
def classify_all_above_threshold(spark, sf_dir):
    """Without a top-N every class at or above the threshold stays."""
    found = classify.top_classes_long(b.long_logits(spark, sf_dir), ["window_id"], 0.0, None)
    return found.select("window_id", "class_idx", "l_partkey", "l_linenumber", b.score6())


@registry.add(
    with_ctes(
        """SELECT recording_id, window_idx, label, round(score, 6) AS score
           FROM top_rows JOIN classes USING (class_idx)""",
        b.WINDOWS_SQL, b.CLASSES_SQL, b.SPECIES_SQL, EXPLODED,
        """allowed AS (SELECT class_idx FROM classes
             WHERE lower(label) IN (SELECT lower(trim(raw)) FROM species))""",
        """top_rows AS (
  SELECT * FROM exploded WHERE score >= -10.0 AND class_idx IN (SELECT class_idx FROM allowed)
  QUALIFY row_number() OVER (PARTITION BY recording_id, window_idx, channel
                             ORDER BY score DESC, class_idx DESC) <= 3)""",
    )
)
def classify_species_filter(spark, sf_dir):
    """The species list limits the classes before the best ones are taken."""
    names = b.classes(spark, sf_dir)
    allowed = classify.allowed_classes(names, b.species(spark, sf_dir))
    found = classify.top_classes(_logit_windows(spark, sf_dir), "logits", THRESHOLD, TOP, allowed)
    return classify.name_classes(found, names).select("recording_id", "window_idx", "label", b.score6())


@registry.add(
    with_ctes(
        """SELECT recording_id, offset_s, label AS species, round(score, 6) AS score
           FROM top_rows JOIN classes USING (class_idx)""",
        b.WINDOWS_SQL, b.CLASSES_SQL, b.SPECIES_SQL, EXPLODED,
        """top_rows AS (
  SELECT * FROM exploded
  WHERE score >= -10.0 AND class_idx IN (SELECT n_nationkey FROM nation)
  QUALIFY row_number() OVER (PARTITION BY recording_id, window_idx, channel
                             ORDER BY score DESC, class_idx DESC) <= 3)""",
    )
)
def classify_species_validated(spark, sf_dir):
    """A checked species list; a name that no class has must stop the job."""
    windows, names, wanted = _logit_windows(spark, sf_dir), b.classes(spark, sf_dir), b.species(spark, sf_dir)
    stranger = b.table(spark, sf_dir, "region").select(F.lit(0).cast("long").alias("item_ord"), F.col("r_name").alias("raw"))
    try:
        jobs.known_species(wanted.unionByName(stranger), names)
        raise AssertionError("an unknown species went through")
    except ValueError:
        found = jobs.detections(windows, names, THRESHOLD, TOP, wanted)
    return found.select("recording_id", "offset_s", "species", b.score6())


# A list of scientific and common names, one entry per nation: those of odd number are known to the taxonomy.
@registry.add(
    with_ctes(
        """SELECT recording_id, offset_s, label AS species, round(score, 6) AS score
           FROM top_rows JOIN classes USING (class_idx)""",
        b.WINDOWS_SQL, b.CLASSES_SQL, EXPLODED,
        """top_rows AS (
  SELECT * FROM exploded
  WHERE score >= -10.0 AND class_idx IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1)
  QUALIFY row_number() OVER (PARTITION BY recording_id, window_idx, channel
                             ORDER BY score DESC, class_idx DESC) <= 3)""",
    )
)
def classify_species_translated(spark, sf_dir):
    """A species list of ``Scientific_Common`` entries, brought into the classes' names before the check."""
    import warnings

    windows, names = _logit_windows(spark, sf_dir), b.classes(spark, sf_dir)
    nations = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("scientific"))
    listed = nations.select(F.concat(F.initcap("scientific"), F.lit("_Common "), "key").alias("raw"), F.col("key").alias("item_ord"))
    taxonomy = nations.where("key % 2 = 1").select(
        F.col("scientific").alias("src"), F.concat(F.lit("class_"), "key").alias("dst"), F.col("key").alias("ord")
    )

    def translate(items):
        return labels.translate_code_first(items, names.select("label"), taxonomy)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = jobs.detections(windows, names, THRESHOLD, TOP, listed, translate)
    return found.select("recording_id", "offset_s", "species", b.score6())


@registry.add(
    with_ctes(
        "SELECT window_id, class_idx, round(score, 6) AS score FROM top_rows",
        b.LONG_LOGITS_SQL, b.LONG_CLASSES_SQL, LONG_SCORED,
        """allowed AS (SELECT * FROM scored
             WHERE class_idx IN (SELECT class_idx FROM long_classes WHERE s_acctbal > 0))""",
        _long_top(3, "allowed"),
    )
)
def classify_species_filter_long(spark, sf_dir):
    """Allowed classes as a semi join, for logits in long form."""
    allowed = b.long_classes(spark, sf_dir).where("s_acctbal > 0")
    found = classify.top_classes_long(
        b.long_logits(spark, sf_dir), ["window_id"], 0.0, 3, allowed, ("l_partkey", "l_linenumber")
    )
    return found.select("window_id", "class_idx", b.score6())


@registry.add(
    with_ctes(
        """SELECT class_idx, label FROM classes
           WHERE lower(label) IN (SELECT lower(trim(raw)) FROM species)""",
        b.CLASSES_SQL, b.SPECIES_SQL,
    )
)
def allowed_classes(spark, sf_dir):
    """Species list to class positions."""
    return classify.allowed_classes(b.classes(spark, sf_dir), b.species(spark, sf_dir))


@registry.add(
    with_ctes(
        """SELECT 'https://api.ecosounds.org/audio_recordings/' || (9000 + recording_id) || '/original' AS source,
                  channel, offset_s AS "offset", label, round(score, 6) AS score,
                  CAST(9000 + recording_id AS VARCHAR) AS audio_recording_id,
                  'site' || (recording_id % 3) || '/classify_results.csv' AS dest
           FROM top_rows JOIN recordings USING (recording_id) JOIN classes USING (class_idx)""",
        b.WINDOWS_SQL, b.RECORDINGS_SQL, b.CLASSES_SQL, EXPLODED, TOP_ROWS,
    )
)
def classify_export(spark, sf_dir):
    """Detections as they are published: mapped source, extra column, destination."""
    smap = SourceMap(template=SOURCE_TEMPLATES["ecosounds_original"], pattern="canonical_filename")
    wide = _logit_windows(spark, sf_dir)
    found = written(jobs.detections(wide, b.classes(spark, sf_dir), THRESHOLD, TOP))
    sources = classify.detection_sources(found, b.recordings(spark, sf_dir))
    mapped = jobs.mapped_recordings(sources, smap)
    rows = jobs.detection_rows(found, mapped, smap, "{parents}/{analysis}{ext}", "csv")
    return rows.withColumn("score", F.round("score", 6))


@registry.add(
    with_ctes(
        """SELECT DISTINCT 'https://example.org/audio_recordings/' || window_id || '/original' AS source, 0 AS channel,
                  l_linenumber * 5.0::DOUBLE AS "offset", label, round(score, 6) AS score,
                  CAST(window_id AS VARCHAR) AS audio_recording_id,
                  CASE WHEN strpos(source, '/') > 0 THEN split_part(source, '/', 1) || '/' ELSE '' END
                    || 'classify_results.parquet' AS dest
           FROM top_rows JOIN long_classes USING (class_idx) JOIN audio_files ON recording_id = window_id""",
        b.LONG_LOGITS_SQL, b.LONG_CLASSES_SQL, b.AUDIO_FILES_SQL, LONG_SCORED, _long_top(3, "scored"),
    )
)
def staged_export(spark, sf_dir):
    """Detections staged as a table with text ids, read back, checked and published as rows."""
    found = classify.top_classes_long(
        b.long_logits(spark, sf_dir), ["window_id"], 0.0, 3, tie_keys=("l_partkey", "l_linenumber")
    )
    offset = F.col("l_linenumber") * F.lit(5.0)
    staged = classify.name_classes(found, b.long_classes(spark, sf_dir)).select(
        window_key(F.col("window_id").cast("string"), offset).alias("window_id"),
        F.col("window_id").cast("string").alias("recording_id"),
        offset.alias("offset_s"),
        F.col("label").alias("species"),
        "score",
    )
    folder = scratch_folder(spark)
    staged.write.parquet(folder)
    rows = staged_detections(spark, folder)
    smap = SourceMap(
        template=SOURCE_TEMPLATES["baw_original"], pattern="canonical_filename", static={"domain": "https://example.org"}
    )
    sources = classify.detection_sources(rows, b.audio_files(spark, sf_dir).select("recording_id", "source"))
    mapped = jobs.mapped_recordings(sources, smap)
    out = jobs.detection_rows(publish.deduplicate(rows.drop("window_id")), mapped, smap, "{parents}/{analysis}{ext}", "parquet")
    return out.withColumn("score", F.round("score", 6))


@registry.add(
    """SELECT CAST(min(len(embedding)) AS INTEGER) AS min_width,
              CAST(max(len(embedding)) AS INTEGER) AS max_width, count(embedding) AS n_vectors FROM embeddings"""
)
def vector_width_check(spark, sf_dir):
    """Smallest and largest vector length, after the check against the class list."""
    from dawnchorus.functions.vectors import widths

    wide = b.table(spark, sf_dir, "embeddings")
    classify.require_matching_width(wide, b.classes(spark, sf_dir), "embedding")
    return widths(wide, "embedding")


# Class codes s<k>; suppliers in credit have a species code c<k>; names exist for some nations,
# under the class code for suppliers in debt or rich ones, and empty where the balance is middling.
CODES_SQL = """codes AS (SELECT CAST(s_suppkey AS INTEGER) AS class_idx, 's' || s_suppkey AS label FROM supplier)"""
TO_CODE_SQL = """to_code AS (
  SELECT s_suppkey AS ord, 's' || s_suppkey AS src, 'c' || s_suppkey AS dst FROM supplier WHERE s_acctbal > 0)"""
TO_NAME_SQL = """to_name AS (
  SELECT s_suppkey AS ord, (CASE WHEN s_acctbal > 8000 OR s_acctbal < 0 THEN 's' ELSE 'c' END) || s_suppkey AS src,
         CASE WHEN s_acctbal BETWEEN 4000 AND 6000 THEN '' ELSE s_name END AS dst
  FROM supplier WHERE s_nationkey < 20)"""


@registry.add(
    with_ctes(
        """SELECT class_idx,
                  coalesce(nullif(n1.dst, ''), nullif(n2.dst, ''), coalesce(t.dst, codes.label)) AS label
           FROM codes LEFT JOIN to_code t ON t.src = codes.label
           LEFT JOIN to_name n1 ON n1.src = coalesce(t.dst, codes.label)
           LEFT JOIN to_name n2 ON n2.src = codes.label""",
        CODES_SQL, TO_CODE_SQL, TO_NAME_SQL,
    )
)
def class_name_resolution(spark, sf_dir):
    """Class codes to species names by two mappings, empty names skipped."""
    s = b.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    text = key.cast("string")
    codes = s.select(key.cast("int").alias("class_idx"), F.concat(F.lit("s"), text).alias("label"))
    to_code = s.where("s_acctbal > 0").select(
        key.alias("ord"), F.concat(F.lit("s"), text).alias("src"), F.concat(F.lit("c"), text).alias("dst")
    )
    balance = F.col("s_acctbal")
    to_name = s.where("s_nationkey < 20").select(
        key.alias("ord"),
        F.concat(F.when((balance > 8000) | (balance < 0), "s").otherwise("c"), text).alias("src"),
        F.when(balance.between(4000, 6000), "").otherwise(F.col("s_name")).alias("dst"),
    )
    return classify.resolve_class_names(codes, to_name, to_code).select("class_idx", "label")


@registry.add(
    """SELECT 'c' || c_nationkey AS src, arg_max(c_name, c_custkey) AS dst
       FROM customer GROUP BY c_nationkey"""
)
def mapping_reversed(spark, sf_dir):
    """Name -> code pairs as code -> name; the last pair of a code stays."""
    pairs = b.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("src"),
        F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("dst"),
        F.col("c_custkey").alias("ord"),
    )
    return classify.reverse_mapping(pairs)


@registry.add(
    with_ctes(
        """SELECT 'embeddings' AS output, dest, count(*) AS n_rows, count(DISTINCT source) AS n_sources
           FROM (SELECT source, regexp_replace(source, '\\.flac$', '.parquet') AS dest
                 FROM windows JOIN recordings USING (recording_id)) GROUP BY dest
           UNION ALL
           SELECT 'classification', 'site' || (recording_id % 3) || '/classify_results.csv', count(*), count(DISTINCT source)
           FROM top_rows JOIN recordings USING (recording_id) GROUP BY 2
           UNION ALL
           SELECT 'recognizers', classifier_name || '.csv', count(*), count(DISTINCT source)
           FROM recognizers CROSS JOIN windows JOIN recordings USING (recording_id) GROUP BY 2""",
        b.WINDOWS_SQL, b.RECORDINGS_SQL, b.RECOGNIZERS_SQL, EXPLODED, TOP_ROWS,
    )
)
def analyze_outputs(spark, sf_dir):
    """All three exports of one run, written and read back: rows and sources per destination."""
    recs = b.recordings(spark, sf_dir).withColumn("duration_s", F.lit(100.0))
    windows = store.windows_by_source(b.windows(spark, sf_dir).drop("label"), recs.drop("duration_s"))
    root = scratch_folder(spark)
    outputs = {
        "embeddings": jobs.Output(f"{root}/emb", "parquet", layout="nested_filestem"),
        "classification": jobs.Output(f"{root}/cls", "csv", layout="nested"),
        "recognizers": jobs.Output(f"{root}/rec", "csv", "{classifier_name}{ext}"),
    }
    jobs.analyze(
        spark, recs, windows.withColumn("logits", F.col("embedding")),
        embed=outputs["embeddings"],
        classification=outputs["classification"], classes=b.classes(spark, sf_dir), threshold=THRESHOLD, top_n=TOP,
        recognition=outputs["recognizers"], recognizers=b.recognizers(spark, sf_dir),
        smap=SourceMap(template=SOURCE_TEMPLATES["ecosounds_original"], pattern="canonical_filename"),
    )
    counted = None
    for name, out in outputs.items():
        rows = publish.read_published(spark, out.root, out.filetype, RESULTS if out.filetype == "csv" else None)
        per_dest = rows.groupBy("dest").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("n_sources")
        ).select(F.lit(name).alias("output"), "dest", "n_rows", "n_sources")
        counted = per_dest if counted is None else counted.unionByName(per_dest)
    return counted
