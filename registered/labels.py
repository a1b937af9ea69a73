"""Label lists and the window store."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnchorus.functions.text import candidate_labels
from dawnchorus.operators import labels, store
from dawnchorus.operators.store import WindowStore
from dawnchorus.sizing import scratch_folder
from dawnchorus.streaming.incremental import add_arrivals

from . import bindings as b
from .bindings import Registry, with_ctes

registry = Registry()

# --- lists ----------------------------------------------------------------

LISTS_SQL = """lists AS (
  SELECT p_partkey AS item_ord, p_name || ', ' || p_type || chr(10) || p_name || ',,' || upper(p_brand) || ' ' AS raw
  FROM part)"""


def lists(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_ord"),
        F.concat("p_name", F.lit(", "), "p_type", F.lit("\n"), "p_name", F.lit(",,"), F.upper("p_brand"), F.lit(" ")).alias("raw"),
    )


@registry.add(
    with_ctes(
        """SELECT value, arg_min(item_ord, item_ord * 1000 + pos) AS item_ord,
                  CAST(arg_min(pos, item_ord * 1000 + pos) AS INTEGER) AS pos
           FROM (SELECT item_ord, kept[i] AS value, i - 1 AS pos
                 FROM (SELECT item_ord, kept, unnest(generate_series(1, len(kept))) AS i
                       FROM (SELECT item_ord, list_filter(list_transform(string_split_regex(raw, '[\\n,]'), lambda x: trim(x)),
                                                          lambda x: x <> '') AS kept FROM lists)))
           GROUP BY value""",
        LISTS_SQL,
    )
)
def species_split(spark, sf_dir):
    """Comma/newline lists to distinct values at their first position."""
    return labels.split_list(lists(spark, sf_dir))


@registry.add(
    with_ctes(
        """SELECT item_ord, array_to_string(list_sort(list_distinct(list_filter(
                    list_transform(string_split_regex(raw, '[\\n,]'), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS items
           FROM lists""",
        LISTS_SQL,
    )
)
def species_list_normalized(spark, sf_dir):
    """Each list lower-cased, distinct and sorted."""
    out = labels.normalize_lists(lists(spark, sf_dir))
    return out.select("item_ord", F.array_join("items", "|").alias("items"))


# Raw labels 'NAME_Brand', some without an underscore.
RAW_SQL = """raw_labels AS (
  SELECT p_partkey AS item_ord, CASE WHEN p_size = 1 THEN ' ' || p_name || ' ' ELSE upper(p_name) || '_ ' || p_brand END AS raw
  FROM part)"""


def raw_labels(spark, sf_dir):
    both = F.concat(F.upper("p_name"), F.lit("_ "), F.col("p_brand"))
    alone = F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_ord"), F.when(F.col("p_size") == 1, alone).otherwise(both).alias("raw")
    )


CANDIDATES_SQL = """cand AS (
  SELECT raw, CAST(o AS INTEGER) AS cand_ord, c AS candidate FROM (
    SELECT raw, unnest(range(len(cs))) AS o, unnest(cs) AS c FROM (
      SELECT raw, CASE WHEN strpos(raw, '_') = 0 THEN [trim(raw)]
                  ELSE [trim(raw), trim(split_part(raw, '_', 1)), trim(substr(raw, strpos(raw, '_') + 1))] END AS cs
      FROM (SELECT DISTINCT raw FROM raw_labels))))"""


@registry.add(
    with_ctes(
        "SELECT item_ord, string_agg(candidate, '|' ORDER BY cand_ord) AS candidates FROM raw_labels JOIN cand USING (raw) GROUP BY item_ord",
        RAW_SQL, CANDIDATES_SQL,
    )
)
def label_candidates(spark, sf_dir):
    """The whole label, then its parts around the first underscore."""
    return raw_labels(spark, sf_dir).select(
        "item_ord", F.array_join(candidate_labels(F.col("raw")), "|").alias("candidates")
    )


# Target taxonomy: codes are some brands, names some part names, two mappings into the names.
CODES_SQL = """code_labels AS (SELECT DISTINCT p_brand AS label FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) < 9)"""
NAME_CODES_SQL = """name_codes AS (
  SELECT p_name AS src, 'p' || p_partkey AS dst, p_partkey AS ord FROM part WHERE p_name >= 'm')"""


def code_labels(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    return part.where(F.substring("p_brand", 7, 9).try_cast("int") < 9).select(F.col("p_brand").alias("label")).distinct()


def name_codes(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").where(F.col("p_name") >= "m")
    return part.select(
        F.col("p_name").alias("src"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("dst"),
        F.col("p_partkey").alias("ord"),
    )


CODE_FIRST_SQL = """code_first AS (
  SELECT raw, arg_min(label, rule * 10 + cand_ord) AS label FROM (
    SELECT raw, cand_ord, 0 AS rule, candidate AS label FROM cand JOIN code_labels ON label = candidate
    UNION ALL
    SELECT raw, cand_ord, 1, dst FROM cand JOIN (SELECT src, arg_max(dst, ord) AS dst FROM name_codes GROUP BY src)
      ON src = lower(candidate))
  GROUP BY raw)"""


def _code_first(spark, sf_dir):
    return labels.translate_code_first(
        raw_labels(spark, sf_dir), code_labels(spark, sf_dir), name_codes(spark, sf_dir)
    )


@registry.add(
    with_ctes(
        "SELECT raw, label FROM (SELECT DISTINCT raw FROM raw_labels) LEFT JOIN code_first USING (raw)",
        RAW_SQL, CANDIDATES_SQL, CODES_SQL, NAME_CODES_SQL, CODE_FIRST_SQL,
    )
)
def taxonomy_translate_code_first(spark, sf_dir):
    """Labels to species codes: all candidates as codes, then all as names."""
    return _code_first(spark, sf_dir)


@registry.add(
    with_ctes(
        "SELECT label, min(item_ord) AS item_ord FROM raw_labels JOIN code_first USING (raw) GROUP BY label",
        RAW_SQL, CANDIDATES_SQL, CODES_SQL, NAME_CODES_SQL, CODE_FIRST_SQL,
    )
)
def taxonomy_translated_list(spark, sf_dir):
    """The translated list, each label at its first position."""
    found = _code_first(spark, sf_dir)
    labels.require_any(found, "codes")
    return labels.translated_list(raw_labels(spark, sf_dir), found)


@registry.add(
    with_ctes(
        "SELECT item_ord, raw FROM raw_labels WHERE raw NOT IN (SELECT raw FROM code_first)",
        RAW_SQL, CANDIDATES_SQL, CODES_SQL, NAME_CODES_SQL, CODE_FIRST_SQL,
    )
)
def taxonomy_unmatched(spark, sf_dir):
    """Entries no rule can translate."""
    return labels.unmatched(raw_labels(spark, sf_dir), _code_first(spark, sf_dir))


VALID_SQL = """valid AS (
  SELECT CASE WHEN p_name < 'h' THEN upper(p_name) ELSE p_name END AS label, p_partkey AS ord
  FROM part WHERE p_name < 'm')"""
MAPPINGS_SQL = """mappings AS (
  SELECT 'a_names' AS mapping, 'names' AS target_namespace, p_partkey AS ord, p_name AS src,
         (SELECT min(label) FROM valid) AS dst FROM part WHERE p_name >= 'm' AND p_name < 's'
  UNION ALL
  SELECT 'b_brands', 'names', p_partkey, p_brand, upper(p_name) FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) < 9
  UNION ALL
  SELECT 'c_other', 'others', p_partkey, p_name, (SELECT max(label) FROM valid) FROM part)"""


def valid(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").where(F.col("p_name") < "m")
    label = F.when(F.col("p_name") < "h", F.upper("p_name")).otherwise(F.col("p_name"))
    return part.select(label.alias("label"), F.col("p_partkey").alias("ord"))


def mappings(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    low, high = valid(spark, sf_dir).agg(F.min("label"), F.max("label")).first()
    names = part.where((F.col("p_name") >= "m") & (F.col("p_name") < "s"))
    brands = part.where(F.substring("p_brand", 7, 9).try_cast("int") < 9)

    def rows(df, mapping, target, src, dst):
        return df.select(
            F.lit(mapping).alias("mapping"), F.lit(target).alias("target_namespace"),
            F.col("p_partkey").alias("ord"), F.col(src).alias("src"), dst.alias("dst"),
        )

    return (
        rows(names, "a_names", "names", "p_name", F.lit(low))
        .unionByName(rows(brands, "b_brands", "names", "p_brand", F.upper("p_name")))
        .unionByName(rows(part, "c_other", "others", "p_name", F.lit(high)))
    )


@registry.add(
    with_ctes(
        """SELECT raw, label FROM (SELECT DISTINCT raw FROM raw_labels) LEFT JOIN (
             SELECT raw, arg_min(label, cand_ord * 100 + rule) AS label FROM (
               SELECT raw, cand_ord, 0 AS rule, candidate AS label FROM cand WHERE candidate IN (SELECT label FROM valid)
               UNION ALL
               SELECT raw, cand_ord, 1, l.label FROM cand JOIN by_lower l ON l.low = lower(candidate)
               UNION ALL
               SELECT raw, cand_ord, 2 + m_ord, coalesce(v.label, l.label)
               FROM (SELECT c.raw, c.cand_ord, n.m_ord, coalesce(p1.dst, p2.dst) AS dst
                     FROM cand c CROSS JOIN (SELECT DISTINCT mapping, CASE mapping WHEN 'a_names' THEN 0 ELSE 1 END AS m_ord FROM pairs) n
                     LEFT JOIN pairs p1 ON p1.mapping = n.mapping AND p1.src = c.candidate
                     LEFT JOIN pairs p2 ON p2.mapping = n.mapping AND p2.src = lower(c.candidate)) m
               LEFT JOIN (SELECT DISTINCT label FROM valid) v ON v.label = m.dst
               LEFT JOIN by_lower l ON l.low = lower(m.dst)
               WHERE m.dst IS NOT NULL AND coalesce(v.label, l.label) IS NOT NULL)
             GROUP BY raw) USING (raw)""",
        RAW_SQL, CANDIDATES_SQL, VALID_SQL, MAPPINGS_SQL,
        "by_lower AS (SELECT lower(label) AS low, arg_max(label, ord) AS label FROM valid GROUP BY 1)",
        "pairs AS (SELECT mapping, src, arg_max(dst, ord) AS dst FROM mappings WHERE target_namespace = 'names' GROUP BY 1, 2)",
    )
)
def taxonomy_translate_name_first(spark, sf_dir):
    """Labels to valid names: every rule on a candidate before the next candidate."""
    return labels.translate_name_first(
        raw_labels(spark, sf_dir), valid(spark, sf_dir), mappings(spark, sf_dir), "names"
    )


OBSERVED_SQL = """observed AS (
  SELECT p_partkey AS item_ord, CASE WHEN p_size = 50 THEN 'unknown ' || p_type ELSE ' ' || lower(p_brand) END AS raw FROM part)"""


def observed(spark, sf_dir):
    unknown = F.concat(F.lit("unknown "), "p_type")
    known = F.concat(F.lit(" "), F.lower("p_brand"))
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_ord"), F.when(F.col("p_size") == 50, unknown).otherwise(known).alias("raw")
    )


def allowed(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("ord"))


@registry.add(
    with_ctes(
        """SELECT raw, min(item_ord) AS item_ord, any_value(label) AS label
           FROM observed LEFT JOIN (SELECT DISTINCT p_brand AS label FROM part) ON lower(label) = lower(trim(raw))
           GROUP BY raw""",
        OBSERVED_SQL,
    )
)
def species_canonicalize(spark, sf_dir):
    """Entries matched to the allowed names ignoring case; unknown ones have none."""
    return labels.canonicalize(observed(spark, sf_dir), allowed(spark, sf_dir))


@registry.add(
    with_ctes(
        """SELECT label, min(item_ord) AS item_ord FROM observed
           JOIN (SELECT DISTINCT p_brand AS label FROM part) ON lower(label) = lower(trim(raw)) GROUP BY label""",
        OBSERVED_SQL,
    )
)
def species_canonical_list(spark, sf_dir):
    """Canonical names, each once, in first-seen order."""
    return labels.canonical_list(labels.canonicalize(observed(spark, sf_dir), allowed(spark, sf_dir)))


@registry.add(
    with_ctes(
        """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, label
           FROM lineitem JOIN raw_labels ON item_ord = l_partkey LEFT JOIN code_first USING (raw)""",
        RAW_SQL, CANDIDATES_SQL, CODES_SQL, NAME_CODES_SQL, CODE_FIRST_SQL,
    )
)
def labels_harmonized(spark, sf_dir):
    """The translation joined back to a fact table with a label column."""
    raw = raw_labels(spark, sf_dir)
    facts = b.table(spark, sf_dir, "lineitem").join(raw.withColumnRenamed("item_ord", "l_partkey"), "l_partkey")
    out = labels.harmonize(facts, "raw", _code_first(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "label")


# --- window store ---------------------------------------------------------

# Incoming windows: all order lines; the store holds those of finished orders.
HELD_SQL = """held AS (
  SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"""


def _incoming(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("recording_id"),
        F.col("l_linenumber").alias("window_idx"),
        F.col("l_suppkey").cast("int").alias("channel"),
    )


def _held(spark, sf_dir):
    done = b.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return _incoming(spark, sf_dir).join(done, F.col("recording_id") == F.col("o_orderkey"), "left_semi")


@registry.add(
    with_ctes(
        """SELECT l_orderkey AS recording_id, l_linenumber AS window_idx, CAST(l_suppkey AS INTEGER) AS channel
           FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.l_orderkey = i.l_orderkey
             AND h.l_linenumber = i.l_linenumber AND h.l_suppkey = i.l_suppkey)""",
        HELD_SQL,
    )
)
def incremental_new_windows(spark, sf_dir):
    """Incoming windows the store doesn't hold."""
    return store.new_windows(_incoming(spark, sf_dir), _held(spark, sf_dir))


@registry.add(
    with_ctes(
        """SELECT l_orderkey AS recording_id, count(*) AS n_again FROM lineitem i
           WHERE EXISTS (SELECT 1 FROM held h WHERE h.l_orderkey = i.l_orderkey
             AND h.l_linenumber = i.l_linenumber AND h.l_suppkey = i.l_suppkey) GROUP BY 1""",
        HELD_SQL,
    )
)
def incremental_duplicates(spark, sf_dir):
    """Incoming windows already held, counted per recording."""
    again = store.known_windows(_incoming(spark, sf_dir), _held(spark, sf_dir))
    return again.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_again"))


@registry.add(
    """SELECT l_orderkey AS recording_id, count(*) AS n_windows FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1"""
)
def window_recording_integrity(spark, sf_dir):
    """Windows whose recording is unknown."""
    recordings = b.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return store.unknown_recordings(
        _incoming(spark, sf_dir), recordings.select(F.col("o_orderkey").alias("recording_id"))
    )


@registry.add(
    with_ctes(
        """SELECT source, l_linenumber AS window_idx, CAST(l_suppkey AS INTEGER) AS channel
           FROM lineitem JOIN audio_files ON recording_id = l_orderkey""",
        b.AUDIO_FILES_SQL,
    )
)
def windows_by_source(spark, sf_dir):
    """Windows with the source of their recording."""
    recordings = b.audio_files(spark, sf_dir).select("recording_id", "source")
    incoming = _incoming(spark, sf_dir)
    store.require_known_recordings(incoming, recordings)
    return store.windows_by_source(incoming, recordings).select("source", "window_idx", "channel")


@registry.add(
    with_ctes(
        """SELECT 'site' || (recording_id % 3) AS deployment, recording_id, window_idx, offset_s,
                  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vector_sum FROM windows""",
        b.WINDOWS_SQL,
    )
)
def window_store(spark, sf_dir):
    """The store after two additions: first one deployment, then everything not yet held."""
    recs = b.recordings(spark, sf_dir).withColumn("deployment", F.split("source", "/")[0])
    rows = store.windows_by_source(b.windows(spark, sf_dir).drop("label"), recs).drop("source")
    kept = WindowStore(spark, scratch_folder(spark))
    first = F.col("deployment") == "site0"
    kept.add(recs.where(first), rows.where(first))
    kept.add(recs, rows, duplicates="skip")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return kept.windows.select(
        "deployment", "recording_id", "window_idx", "offset_s", F.round(total, 6).alias("vector_sum")
    )


def _two_additions(spark, sf_dir):
    """A store whose first version holds one deployment, whose second everything."""
    recs = b.recordings(spark, sf_dir).withColumn("deployment", F.split("source", "/")[0])
    rows = store.windows_by_source(b.windows(spark, sf_dir).drop("label"), recs).drop("source")
    kept = WindowStore(spark, scratch_folder(spark))
    first = F.col("deployment") == "site0"
    kept.add(recs.where(first), rows.where(first))
    kept.add(recs, rows, duplicates="skip")
    return kept, recs


@registry.add(
    with_ctes(
        """SELECT 'site' || (recording_id % 3) AS deployment, recording_id, count(*) AS n_windows
           FROM windows GROUP BY recording_id""",
        b.WINDOWS_SQL,
    )
)
def window_store_index(spark, sf_dir):
    """Windows per recording from the store's index, no window read."""
    return _two_additions(spark, sf_dir)[0].counts()


@registry.add(
    with_ctes(
        """SELECT v AS version, 'site' || (recording_id % 3) AS deployment, count(*) AS n_windows,
                  count(DISTINCT recording_id) AS n_recordings
           FROM windows, (VALUES (1), (2)) x(v) WHERE v = 2 OR recording_id % 3 = 0 GROUP BY 1, 2""",
        b.WINDOWS_SQL,
    )
)
def window_store_versions(spark, sf_dir):
    """Each version shows what it was made of, whatever came later."""
    kept, _ = _two_additions(spark, sf_dir)
    shown = [kept.windows_at(v).withColumn("version", F.lit(v)) for v in (1, kept.version())]
    return shown[0].unionByName(shown[1]).groupBy("version", "deployment").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_distinct("recording_id").alias("n_recordings")
    )


@registry.add(
    with_ctes(
        """SELECT 'site' || (recording_id % 3) AS deployment, recording_id, window_idx, offset_s
           FROM windows WHERE recording_id % 3 = 1 AND recording_id % 2 = 0""",
        b.WINDOWS_SQL,
    )
)
def window_store_lookup(spark, sf_dir):
    """Stored windows of some recordings, read from their deployment alone."""
    kept, recs = _two_additions(spark, sf_dir)
    found = kept.windows_of(recs.where("recording_id % 3 = 1 AND recording_id % 2 = 0").select("recording_id"))
    return found.select("deployment", "recording_id", "window_idx", "offset_s")


@registry.add(
    with_ctes(
        """SELECT 'site' || (recording_id % 3) AS deployment, source, window_idx, offset_s,
                  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vector_sum
           FROM windows JOIN recordings USING (recording_id)""",
        b.WINDOWS_SQL, b.RECORDINGS_SQL,
    )
)
def window_stream(spark, sf_dir):
    """The store filled from arriving window files, called again with nothing new."""
    recs = b.recordings(spark, sf_dir).withColumn("deployment", F.split("source", "/")[0])
    rows = store.windows_by_source(b.windows(spark, sf_dir).drop("label"), recs)
    folder = scratch_folder(spark)
    arrivals = f"{folder}/arrivals"
    rows.write.parquet(arrivals)
    for _ in range(2):
        add_arrivals(spark, arrivals, rows.schema, f"{folder}/store", f"{folder}/mark")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return WindowStore(spark, f"{folder}/store").windows.select(
        "deployment", "source", "window_idx", "offset_s", F.round(total, 6).alias("vector_sum")
    )
