"""Framing, file listings, file-name metadata, destinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnchorus.functions import text
from dawnchorus.operators import framing, publish, routing, sourcemap, store
from dawnchorus.operators.sourcemap import SOURCE_TEMPLATES, SourceMap
from dawnchorus.sinks import tree as tree_sink
from dawnchorus.sizing import scratch_folder, written_counted
from dawnchorus.sources import audio_tree

from . import bindings as b
from .bindings import Registry, with_ctes

registry = Registry()

# --- framing --------------------------------------------------------------

SHARDS_SQL = """shards AS (
  SELECT *, i * 60.0::DOUBLE AS shard_offset_s, least(60.0::DOUBLE, duration_s - i * 60.0::DOUBLE) AS shard_len_s
  FROM (SELECT *, unnest(generate_series(0, CAST(ceil(duration_s / 60) AS BIGINT) - 1)) AS i FROM line_recordings)
  WHERE least(60.0::DOUBLE, duration_s - i * 60.0::DOUBLE) >= 1.0)"""


@registry.add(
    with_ctes(
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(i AS INTEGER) AS shard_idx,
                  shard_offset_s, shard_len_s FROM shards""",
        b.LINE_RECORDINGS_SQL, SHARDS_SQL,
    )
)
def frame_shards(spark, sf_dir):
    """Recordings cut into 60 s shards."""
    return framing.shard_recordings(b.line_recordings(spark, sf_dir)).drop("duration_s")


@registry.add(
    with_ctes(
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(i * 12 + t AS INTEGER) AS window_idx,
                  shard_offset_s + t * 5.0 AS offset_s, shard_offset_s + t * 5.0 + 5.0 AS end_s
           FROM (SELECT *, unnest(generate_series(0, greatest(1, CAST(floor(shard_len_s / 5) AS BIGINT)) - 1)) AS t
                 FROM shards)""",
        b.LINE_RECORDINGS_SQL, SHARDS_SQL,
    )
)
def frame_windows(spark, sf_dir):
    """Whole 5 s windows of every shard."""
    windows = framing.window_shards(framing.shard_recordings(b.line_recordings(spark, sf_dir)))
    return windows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "window_idx", "offset_s", "end_s"
    )


@registry.add(
    with_ctes(
        """SELECT l_orderkey, l_linenumber, count(*) AS n_windows, max(offset_s) AS last_offset_s
           FROM (SELECT *, shard_offset_s + t * 5.0 AS offset_s
                 FROM (SELECT *, unnest(generate_series(0, CAST(ceil(shard_len_s / 5) AS BIGINT) - 1)) AS t FROM shards))
           GROUP BY l_orderkey, l_linenumber""",
        b.LINE_RECORDINGS_SQL, SHARDS_SQL,
    )
)
def frame_windows_padded(spark, sf_dir):
    """A rest shorter than a window is padded to one."""
    shards = framing.shard_recordings(b.line_recordings(spark, sf_dir))
    windows = framing.window_shards(shards, partial="pad")
    return windows.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("offset_s").alias("last_offset_s")
    )


@registry.add(
    with_ctes(
        """SELECT vec_id, source || '_' || CAST(offset_s AS VARCHAR) AS window_id
           FROM (SELECT vec_id, vec_id // 20 AS recording_id, CAST(vec_id % 20 AS DOUBLE) * 5.0 AS offset_s FROM embeddings)
           JOIN recordings USING (recording_id)""",
        b.RECORDINGS_SQL,
    )
)
def window_keys(spark, sf_dir):
    """Text keys of windows: source and offset."""
    rows = store.windows_by_source(b.windows(spark, sf_dir), b.recordings(spark, sf_dir))
    vec_id = F.col("recording_id") * 20 + F.col("window_idx")
    return rows.select(vec_id.alias("vec_id"), text.window_key(F.col("source"), F.col("offset_s")).alias("window_id"))


@registry.add(
    with_ctes(
        """SELECT count(*) AS n_files, round(sum(coalesce(duration_s, 0)), 2) AS total_s,
                  round(avg(coalesce(duration_s, 0)), 4) AS avg_s FROM audio_files""",
        b.AUDIO_FILES_SQL,
    )
)
def manifest_statistics(spark, sf_dir):
    """Number and length of files; unreadable ones count as 0 seconds."""
    stats = audio_tree.manifest_statistics(b.audio_files(spark, sf_dir))
    return stats.select("n_files", F.round("total_s", 2).alias("total_s"), F.round("avg_s", 4).alias("avg_s"))


@registry.add(
    with_ctes(
        """SELECT n AS windows, audio_s, 36.0::DOUBLE AS elapsed_s, 36.0::DOUBLE / (audio_s / 3600) AS elapsed_s_per_audio_hour
           FROM (SELECT count(*) AS n FROM
                   (SELECT unnest(generate_series(0, greatest(1, CAST(floor(shard_len_s / 5) AS BIGINT)) - 1)) FROM shards)),
                (SELECT sum(duration_s) AS audio_s FROM line_recordings)""",
        b.LINE_RECORDINGS_SQL, SHARDS_SQL,
    )
)
def run_summary(spark, sf_dir):
    """Windows of a run, counted while they are written, the length of its audio, and its speed for a given time."""
    recordings = b.line_recordings(spark, sf_dir)
    windows = framing.window_shards(framing.shard_recordings(recordings))
    _, n = written_counted(windows, scratch_folder(spark))
    return store.summary_of(recordings, n, 36.0)


@registry.add(
    with_ctes(
        """SELECT recording_id, mapped_source, audio_recording_id, parents || stem || '/embeddings.parquet' AS dest_embeddings,
                  parents || 'classify_results.csv' AS dest_classify, '<' || stem || '.csv' AS dest_recognizer
           FROM (SELECT recording_id, 'https://api.ecosounds.org/audio_recordings/' || recording_id || '/original' AS mapped_source,
                        CAST(recording_id AS VARCHAR) AS audio_recording_id,
                        CASE WHEN strpos(source, '/') > 0 THEN split_part(source, '/', 1) || '/' ELSE '' END AS parents,
                        regexp_replace(string_split(source, '/')[-1], '\\.flac$', '') AS stem FROM audio_files)""",
        b.AUDIO_FILES_SQL,
    )
)
def routes_per_recording(spark, sf_dir):
    """Published source, extra columns and destinations worked out once per recording."""
    from dawnchorus.plans import jobs

    smap = SourceMap(template=SOURCE_TEMPLATES["ecosounds_original"], pattern="canonical_filename")
    out = jobs.routed(
        b.audio_files(spark, sf_dir).select("recording_id", "source"), smap,
        embed=jobs.Output("", "parquet", "{parents}/{filestem}/{analysis}{ext}"),
        classification=jobs.Output("", "csv", layout="nested"),
        recognition=jobs.Output("", "csv", "{classifier_name}{filestem}{ext}"),
    )
    return out.select(
        "recording_id", "mapped_source", F.col("extra_audio_recording_id").alias("audio_recording_id"), "dest_embeddings", "dest_classify",
        F.replace("dest_recognizer", F.lit("\x01"), F.lit("<")).alias("dest_recognizer"),
    )


# --- listings -------------------------------------------------------------

# File names from parts, with extensions of either case, audio or not.
PART_FILES_SQL = """part_files AS (
  SELECT p_partkey, p_brand || '/' || p_name || CASE p_size % 7
           WHEN 0 THEN '.wav' WHEN 1 THEN '.FLAC' WHEN 2 THEN '.Mp3' WHEN 3 THEN '.ogg'
           WHEN 4 THEN '.txt' WHEN 5 THEN '.wav.bak' ELSE '' END AS source
  FROM part)"""


def part_files(spark, sf_dir):
    kind = F.col("p_size") % 7
    ext = (
        F.when(kind == 0, ".wav").when(kind == 1, ".FLAC").when(kind == 2, ".Mp3")
        .when(kind == 3, ".ogg").when(kind == 4, ".txt").when(kind == 5, ".wav.bak").otherwise("")
    )
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_name", ext).alias("source")
    )


@registry.add(
    with_ctes(
        r"SELECT p_partkey, source FROM part_files WHERE regexp_matches(lower(source), '\.(wav|flac|mp3|ogg)$')",
        PART_FILES_SQL,
    )
)
def manifest_audio_files(spark, sf_dir):
    """Audio files by extension, whatever its case."""
    return audio_tree.audio_only(part_files(spark, sf_dir))


# A tree written from the suppliers: names with an underscore or a dot in front, in folders that have them too.
SUPPLIER_FILES_SQL = """supplier_files AS (
  SELECT CASE s_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_n' || s_nationkey || '/' ELSE 'n/.' || s_nationkey || '/' END
           || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_' ELSE '.' END || s_suppkey
           || CASE s_suppkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.FLAC' ELSE '.wav' END AS source,
         CAST(length(s_name) AS BIGINT) AS length FROM supplier)"""


def _write_files(batches):
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            system, path = fs.FileSystem.from_uri(row["path"]) if "://" in row["path"] else (fs.LocalFileSystem(), row["path"])
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(row["body"].encode())
        yield batch.select(["path"])


@registry.add(
    with_ctes(
        r"""SELECT source, length, CAST(1 + length(source) - length(replace(source, '/', '')) AS INTEGER) AS depth
           FROM supplier_files WHERE regexp_matches(lower(source), '\.(wav|flac)$')""",
        SUPPLIER_FILES_SQL,
    )
)
def manifest_listing(spark, sf_dir):
    """Files written from a table, listed from the tree; hidden names count."""
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    folder = F.when(nation % 3 == 0, "").when(nation % 3 == 1, F.concat(F.lit("_n"), nation, F.lit("/")))
    folder = folder.otherwise(F.concat(F.lit("n/."), nation, F.lit("/")))
    mark = F.when(key % 3 == 0, "").when(key % 3 == 1, "_").otherwise(".")
    ext = F.when(key % 4 == 0, ".txt").when(key % 4 == 1, ".FLAC").otherwise(".wav")
    root = scratch_folder(spark)
    path = F.concat(F.lit(root + "/"), folder, mark, key, ext)
    files = b.table(spark, sf_dir, "supplier").select(path.alias("path"), F.col("s_name").alias("body"))
    files.mapInArrow(_write_files, "path string").count()
    return audio_tree.list_tree(spark, root).select("source", "length", "depth")


PAGE_DEPTH_SQL = """page_depth AS (
  SELECT page_id, source, CAST(len(list_filter(string_split(source, '/'), lambda p: p NOT IN ('', '.'))) AS INTEGER) AS depth
  FROM page_paths)"""


@registry.add(
    with_ctes(
        "SELECT page_id, source, depth FROM page_depth WHERE depth = (SELECT min(depth) FROM page_depth)",
        b.PAGE_PATHS_SQL, PAGE_DEPTH_SQL,
    )
)
def manifest_depth_select(spark, sf_dir):
    """Files at the shallowest depth."""
    files = audio_tree.with_depth(b.page_paths(spark, sf_dir))
    return audio_tree.at_shallowest_depth(files)[0]


# Depths that differ: files at the root, in a site folder, in a day folder below it.
TREE_SQL = """tree AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'site/' ELSE 'site/day/' END
           || event_id || '.wav' AS source,
         CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS depth
  FROM events)"""


def tree(spark, sf_dir):
    kind = F.col("event_type")
    folder = F.when(kind == "click", "").when(kind == "view", "site/").otherwise("site/day/")
    return b.table(spark, sf_dir, "events").select(
        "event_id", F.concat(folder, F.col("event_id").cast("string"), F.lit(".wav")).alias("source")
    )


@registry.add(
    with_ctes(
        """SELECT min(depth) AS depth, count(*) FILTER (depth = (SELECT min(depth) FROM tree)) AS n_kept,
                  count(*) FILTER (depth > (SELECT min(depth) FROM tree)) AS n_skipped FROM tree""",
        TREE_SQL,
    )
)
def manifest_depth_summary(spark, sf_dir):
    """Shallowest depth, files kept and skipped."""
    return audio_tree.depth_summary(audio_tree.with_depth(tree(spark, sf_dir)))


@registry.add(
    with_ctes("SELECT event_id, source FROM tree WHERE regexp_matches(source, '^[^/]*/[^/]*\\.wav$')", TREE_SQL)
)
def manifest_glob(spark, sf_dir):
    """Files matching a path glob, one folder deep."""
    return audio_tree.matching_glob(tree(spark, sf_dir), "*/*.wav")


@registry.add(
    with_ctes(
        """SELECT source, CASE WHEN strpos(source, '/') > 0 THEN split_part(source, '/', 1) ELSE 'search_set' END AS deployment,
                  'search_set' AS dataset FROM audio_files""",
        b.AUDIO_FILES_SQL,
    )
)
def deployments(spark, sf_dir):
    """Deployment and dataset of each recording; ids are checked for collisions."""
    recs = store.with_recordings(b.audio_files(spark, sf_dir).select("source"), "search_set")
    store.require_unique_ids(recs)
    return recs.drop("recording_id")


# --- metadata and source map ----------------------------------------------

CANONICAL_SQL = r"'^(\d{8}T\d{6}(?:[+-]\d{4,6}|Z))_(.+)_(\d+)\.(.+)$'"


@registry.add(
    with_ctes(
        f"""SELECT recording_id, nullif(regexp_extract(name, {CANONICAL_SQL}, 1), '') AS "timestamp",
                   nullif(regexp_extract(name, {CANONICAL_SQL}, 2), '') AS site_name,
                   nullif(regexp_extract(name, {CANONICAL_SQL}, 3), '') AS audio_recording_id,
                   nullif(regexp_extract(name, {CANONICAL_SQL}, 4), '') AS extension
            FROM (SELECT recording_id, string_split(source, '/')[-1] AS name FROM audio_files)""",
        b.AUDIO_FILES_SQL,
    )
)
def metadata_extract(spark, sf_dir):
    """The canonical file-name pattern."""
    smap = SourceMap(pattern="canonical_filename")
    files = b.audio_files(spark, sf_dir)
    return files.select("recording_id", *[c.alias(n) for n, c in smap.metadata(F.col("source")).items()])


PAGE_PATTERN = r"^(?P<audio_recording_id>\d+)(?:\.(?P<extension>\w+))?"


@registry.add(
    with_ctes(
        r"""SELECT page_id, 'https://example.org' AS "domain",
                   coalesce(nullif(regexp_extract(name, '^(\d+)(?:\.(\w+))?', 1), ''), '0') AS audio_recording_id,
                   coalesce(nullif(regexp_extract(name, '^(\d+)(?:\.(\w+))?', 2), ''), 'none') AS extension
            FROM page_names""",
        b.PAGE_PATHS_SQL, b.PAGE_NAMES_SQL,
    )
)
def metadata_merge(spark, sf_dir):
    """Extracted values over static ones; an unmatched group keeps the static value."""
    static = {"domain": "https://example.org", "audio_recording_id": "0", "extension": "none"}
    smap = SourceMap(pattern=PAGE_PATTERN, static=static)
    pages = b.page_paths(spark, sf_dir)
    return pages.select("page_id", *[c.alias(n) for n, c in smap.metadata(F.col("source")).items()])


@registry.add(
    with_ctes(
        r"""SELECT page_id, regexp_extract(name, '^(\d*)(.*)$', 1) AS digits,
                   regexp_extract(name, '^(\d*)(.*)$', 2) AS rest FROM page_names""",
        b.PAGE_PATHS_SQL, b.PAGE_NAMES_SQL,
    )
)
def metadata_empty_groups(spark, sf_dir):
    """Groups that may match nothing yield an empty text, not a missing value."""
    smap = SourceMap(pattern=r"^(?P<digits>\d*)(?P<rest>.*)$")
    pages = b.page_paths(spark, sf_dir)
    return pages.select("page_id", *[c.alias(n) for n, c in smap.metadata(F.col("source")).items()])


@registry.add(
    with_ctes(
        """SELECT recording_id, source,
                  'https://api.ecosounds.org/audio_recordings/' || recording_id || '/original' AS mapped_source,
                  CAST(recording_id AS VARCHAR) AS audio_recording_id
           FROM audio_files""",
        b.AUDIO_FILES_SQL,
    )
)
def sourcemap_render(spark, sf_dir):
    """Sources rewritten by a preset, with the extra column, after all checks."""
    smap = SourceMap(template=SOURCE_TEMPLATES["ecosounds_original"], pattern="canonical_filename")
    files = b.audio_files(spark, sf_dir).select("recording_id", "source")
    mapped = sourcemap.map_sources(files, smap)
    sourcemap.require_mapped(mapped, smap)
    return mapped


PAGE_MAPPED_SQL = r"""page_mapped AS (
  SELECT DISTINCT source, 'https://example.org/audio_recordings/'
           || nullif(regexp_extract(name, '^(\d+)(?:\.(\w+))?', 1), '') || '/original' AS mapped_source
  FROM page_names)"""


def page_mapped(spark, sf_dir):
    smap = SourceMap(template=SOURCE_TEMPLATES["baw_original"], pattern=PAGE_PATTERN, static={"domain": "https://example.org"})
    return sourcemap.map_sources(sourcemap.distinct_sources(b.page_paths(spark, sf_dir)), smap, ())


@registry.add(
    with_ctes(
        """SELECT mapped_source, source FROM page_mapped
           WHERE mapped_source IN (SELECT mapped_source FROM page_mapped GROUP BY 1 HAVING count(*) > 1)""",
        b.PAGE_PATHS_SQL, b.PAGE_NAMES_SQL, PAGE_MAPPED_SQL,
    )
)
def sourcemap_collisions(spark, sf_dir):
    """All sources that share a published value."""
    return sourcemap.collisions(page_mapped(spark, sf_dir))


@registry.add(
    with_ctes(
        """SELECT mapped_source, count(*) AS n_sources, min(source) AS first_source, max(source) AS last_source
           FROM page_mapped WHERE mapped_source IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
        b.PAGE_PATHS_SQL, b.PAGE_NAMES_SQL, PAGE_MAPPED_SQL,
    )
)
def sourcemap_collision_summary(spark, sf_dir):
    """Shared published values with the number of their sources."""
    return sourcemap.collision_summary(page_mapped(spark, sf_dir)).where("mapped_source IS NOT NULL")


@registry.add(
    with_ctes(
        r"""SELECT source FROM audio_files WHERE NOT regexp_matches(source, '_5-LOW_')""", b.AUDIO_FILES_SQL
    )
)
def sourcemap_unresolved(spark, sf_dir):
    """Sources for which the template has a token without a value."""
    smap = SourceMap(template="https://example.org/{low_id}", pattern=r"_5-LOW_(?P<low_id>\d+)\.")
    return sourcemap.unresolved(sourcemap.map_sources(b.audio_files(spark, sf_dir).select("source"), smap, ()))


@registry.add(
    with_ctes(
        """SELECT source, CAST(recording_id AS VARCHAR) AS audio_recording_id, 'https://example.org' AS "domain"
           FROM audio_files""",
        b.AUDIO_FILES_SQL,
    )
)
def extra_columns(spark, sf_dir):
    """Extra columns that at least one source fills; others are left out."""
    smap = SourceMap(
        pattern=r"_(?P<audio_recording_id>\d+)\.flac|(?P<never>\d{30})", static={"domain": "https://example.org"}
    )
    names = ("audio_recording_id", "domain", "never", "missing")
    mapped = sourcemap.map_sources(b.audio_files(spark, sf_dir).select("source"), smap, names)
    return mapped.select("source", *sourcemap.present_extras(mapped, names))


# --- destinations ---------------------------------------------------------

PAGE_TOKENS_SQL = r"""page_tokens AS (
  SELECT page_id, source, name, array_to_string(string_split(rtrim(source, '/'), '/')[:-2], '/') AS parents,
         regexp_replace(name, '(.)\.[^.]+$', '\1') AS stem
  FROM page_names)"""


@registry.add(
    with_ctes(
        """SELECT page_id, parents || '/' || stem || '.csv' AS nested_filestem, stem || '.csv' AS flat_filestem,
                  parents || '/classify_results.csv' AS nested, 'classify_results.csv' AS flat
           FROM page_tokens""",
        b.PAGE_PATHS_SQL, b.PAGE_NAMES_SQL, PAGE_TOKENS_SQL,
    )
)
def path_render(spark, sf_dir):
    """Destinations of every source in the four layouts."""
    pages = b.page_paths(spark, sf_dir)
    return pages.select(
        "page_id",
        *[routing.destination(F.col("source"), t, "classify", "csv").alias(n) for n, t in routing.LAYOUTS.items()],
    )


@registry.add(
    with_ctes(
        """SELECT page_id, 'out/' || stem || CASE WHEN regexp_matches(stem, '..*\\.parquet$') THEN '' ELSE '.parquet' END AS appended,
                  'serialized/embeddings/' || parents || '.tab.parquet' AS fixed_suffix
           FROM page_tokens""",
        b.PAGE_PATHS_SQL, b.PAGE_NAMES_SQL, PAGE_TOKENS_SQL,
    )
)
def path_extension_appended(spark, sf_dir):
    """Paths without the output's extension get it appended."""
    import warnings

    pages = b.page_paths(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pages.select(
            "page_id",
            routing.destination(F.col("source"), "/out//{filestem}".lstrip("/"), "embeddings", "parquet").alias("appended"),
            routing.destination(
                F.col("source"), "{embeddings_table_format}\\{analysis}//{parents}.tab", "embeddings", "parquet", "serialized"
            ).alias("fixed_suffix"),
        )


@registry.add(
    with_ctes(
        """SELECT path FROM (SELECT CASE WHEN source LIKE '%#top' THEN '../' || source
                                         WHEN source LIKE '%/' THEN '/' || source
                                         WHEN source LIKE '%.html' THEN 'a/../' || source
                                         ELSE 'a..b/' || source END AS path FROM page_paths)
           WHERE path LIKE '/%' OR list_contains(string_split(path, '/'), '..')""",
        b.PAGE_PATHS_SQL,
    )
)
def path_unsafe(spark, sf_dir):
    """Absolute paths and paths that climb out of the root."""
    s = F.col("source")
    path = (
        F.when(s.endswith("#top"), F.concat(F.lit("../"), s))
        .when(s.endswith("/"), F.concat(F.lit("/"), s))
        .when(s.endswith(".html"), F.concat(F.lit("a/../"), s))
        .otherwise(F.concat(F.lit("a..b/"), s))
    )
    return routing.unsafe(b.page_paths(spark, sf_dir).select(path.alias("path")), "path")


@registry.add(
    with_ctes(
        """SELECT CASE WHEN strpos(source, '/') > 0 THEN split_part(source, '/', 1) || '/' ELSE '' END
                    || 'recognizer_results.csv' AS dest, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT source) AS n_sources
           FROM lineitem JOIN audio_files ON recording_id = l_orderkey GROUP BY 1""",
        b.AUDIO_FILES_SQL,
    )
)
def route_counts(spark, sf_dir):
    """Rows and sources merged into each destination."""
    rows = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("recording_id"))
    files = b.audio_files(spark, sf_dir).select("recording_id", "source")
    named = rows.agg(F.count(F.lit(1)).alias("n_rows")).join(files, "recording_id")
    dest = routing.destination(F.col("source"), routing.LAYOUTS["nested"], "recognizer", "csv")
    return routing.route_counts(named.select(dest.alias("dest"), "source", "n_rows"))


# Result rows with repeated (order, line) pairs.
RESULT_ROWS_SQL = """result_rows AS (
  SELECT CASE l_linestatus WHEN 'F' THEN 'final/classify_results.csv' ELSE 'classify_results.csv' END AS dest,
         'rec_' || l_orderkey AS source, 0 AS channel, l_linenumber * 5.0::DOUBLE AS "offset",
         l_returnflag AS label, l_discount AS score
  FROM lineitem)"""


def result_rows(spark, sf_dir):
    dest = F.when(F.col("l_linestatus") == "F", "final/classify_results.csv").otherwise("classify_results.csv")
    return b.table(spark, sf_dir, "lineitem").select(
        dest.alias("dest"),
        F.concat(F.lit("rec_"), F.col("l_orderkey").cast("string")).alias("source"),
        F.lit(0).alias("channel"),
        (F.col("l_linenumber") * F.lit(5.0)).alias("offset"),
        F.col("l_returnflag").alias("label"),
        F.col("l_discount").alias("score"),
    )


@registry.add(with_ctes("SELECT DISTINCT * FROM result_rows", RESULT_ROWS_SQL))
def dedupe_sorted(spark, sf_dir):
    """Distinct rows per destination, ranged and sorted for writing."""
    return publish.arrange(publish.deduplicate(result_rows(spark, sf_dir)))


@registry.add(with_ctes("SELECT DISTINCT * FROM result_rows", RESULT_ROWS_SQL))
def published_parquet(spark, sf_dir):
    """Result rows written as Parquet, a folder per destination, and read back."""
    root = scratch_folder(spark)
    publish.publish(result_rows(spark, sf_dir), root, "parquet", {"runner": "1"})
    return publish.read_published(spark, root)


@registry.add(with_ctes("SELECT DISTINCT * FROM result_rows", RESULT_ROWS_SQL))
def published_csv(spark, sf_dir):
    """The same as CSV, typed on reading by the declared schema."""
    from dawnchorus.schemas import RESULTS

    root = scratch_folder(spark)
    publish.publish(result_rows(spark, sf_dir), root, "csv", {"runner": "1"})
    return publish.read_published(spark, root, "csv", RESULTS)


def _by_path(spark, root, filetype, schema=None):
    """The published files read by their own paths."""
    from functools import reduce

    dests = ("classify_results.csv", "final/classify_results.csv")
    tables = [tree_sink.read_destination(spark, root, d, filetype, schema).withColumn("dest", F.lit(d)) for d in dests]
    return reduce(lambda x, y: x.unionByName(y), tables)


@registry.add(with_ctes("SELECT DISTINCT * FROM result_rows", RESULT_ROWS_SQL))
def published_tree(spark, sf_dir):
    """Result rows as Parquet files at their destinations, read back by path."""
    root = scratch_folder(spark)
    publish.publish(result_rows(spark, sf_dir), root, "parquet", tree=True)
    return _by_path(spark, root, "parquet")


@registry.add(with_ctes("SELECT DISTINCT * FROM result_rows", RESULT_ROWS_SQL))
def published_tree_csv(spark, sf_dir):
    """The same as CSV files."""
    from dawnchorus.schemas import RESULTS

    root = scratch_folder(spark)
    publish.publish(result_rows(spark, sf_dir), root, "csv", tree=True)
    return _by_path(spark, root, "csv", RESULTS)


def _footers(batches):
    """Key-value metadata of Parquet files, Spark's and Arrow's own keys left out."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            with system.open_input_file(inside) as f:
                found = pq.read_metadata(f).metadata
            keys = [k.decode() for k in found if not k.startswith((b"ARROW", b"org.apache"))]
            values = [found[k.encode()].decode() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["name", "value"])


@registry.add(
    with_ctes(
        """SELECT name, CAST(CASE name WHEN 'n_rows' THEN n ELSE d END AS VARCHAR) AS value
           FROM (SELECT count(*) AS n, count(DISTINCT dest) AS d FROM result_rows),
                (VALUES ('n_rows'), ('n_dests')) k(name)""",
        RESULT_ROWS_SQL,
    )
)
def published_footers(spark, sf_dir):
    """Facts about the rows as key-value metadata in the footer of every published Parquet file."""
    rows = result_rows(spark, sf_dir)
    n, d = rows.agg(F.count(F.lit(1)), F.count_distinct("dest")).first()
    root = scratch_folder(spark)
    publish.publish(rows, root, "parquet", {"n_rows": str(n), "n_dests": str(d)}, tree=True)
    files = spark.createDataFrame([(f,) for f in _by_path(spark, root, "parquet").inputFiles()], "path string")
    return files.mapInArrow(_footers, "name string, value string").distinct()


@registry.add(
    with_ctes("SELECT count(*) AS n_files, count(*) > 1 AS refused FROM audio_files", b.AUDIO_FILES_SQL)
)
def sourcemap_guard(spark, sf_dir):
    """A template without a pattern is refused for several files."""
    n = b.audio_files(spark, sf_dir).count()
    try:
        sourcemap.require_pattern_for_many(n, SourceMap(template="https://example.org/one"))
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(n, refused)], "n_files long, refused boolean")


@registry.add(
    with_ctes(
        """SELECT filetype, name, CAST(CASE name WHEN 'n_rows' THEN n ELSE d END AS VARCHAR) AS value
           FROM (SELECT count(*) AS n, count(DISTINCT dest) AS d FROM result_rows),
                (VALUES ('csv'), ('parquet')) f(filetype), (VALUES ('n_rows'), ('n_dests')) k(name)""",
        RESULT_ROWS_SQL,
    )
)
def published_provenance(spark, sf_dir):
    """Facts about the rows, read back from the published tables of both kinds."""
    import json

    rows = result_rows(spark, sf_dir)
    n, d = rows.agg(F.count(F.lit(1)), F.count_distinct("dest")).first()
    found = []
    for filetype in ("csv", "parquet"):
        root = scratch_folder(spark)
        publish.publish(rows, root, filetype, {"n_rows": str(n), "n_dests": str(d)})
        if filetype == "parquet":
            facts = publish.read_provenance(publish.read_published(spark, root))
        else:
            facts = json.loads(spark.read.text(root + "/_provenance").first()["value"])
        found += [(filetype, k, v) for k, v in facts.items()]
    return spark.createDataFrame(found, "filetype string, name string, value string")


@registry.add(
    with_ctes(
        """SELECT DISTINCT dest, source, channel, "offset", label,
                  CASE WHEN dest LIKE 'final/%' THEN score + 1 ELSE score END AS score FROM result_rows""",
        RESULT_ROWS_SQL,
    )
)
def published_again(spark, sf_dir):
    """A second run replaces its own destinations and leaves the others."""
    root = scratch_folder(spark)
    rows = result_rows(spark, sf_dir)
    publish.publish(rows, root)
    publish.publish(rows.where(F.col("dest").startswith("final/")).withColumn("score", F.col("score") + 1), root)
    return publish.read_published(spark, root)
