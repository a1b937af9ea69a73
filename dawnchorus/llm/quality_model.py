"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are distributions over ``2**BITS`` hashed unigrams and bigrams:
the target's from texts labelled good, the raw one from all texts. A text's
log weight is the sum of the log ratios of its features. Adding Gumbel noise
that is fixed by seed, id and text, and taking the ``k`` largest, draws ``k`` texts
without replacement in proportion to their weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm import words as W
from dawnchorus.llm.common import documents_of, stored

BITS = 14
TARGET_ROWS = 20_000  # labelled texts that the target model is fitted on


def _features(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all unigrams and bigrams of a slice."""
    n = len(words.hashes)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    two = W.shingles_of(words.hashes, 2)
    inside = np.flatnonzero(text[1:] == text[:-1]) if n > 1 else np.zeros(0, dtype=np.int64)
    feature = np.concatenate([W.mixed(words.hashes, 31), two[inside]]) >> np.uint64(64 - BITS)
    return np.concatenate([text, text[inside]]), feature.astype(np.int64)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in W.text_slices(batch.column("text")):
            counts += np.bincount(_features(W.words_of(data, offsets, fold=True))[1], minlength=1 << BITS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["feature", "n"])


def feature_model(texts: DataFrame) -> np.ndarray:
    """Log probability of each feature in a ``text`` column, add-one smoothed; 2**BITS numbers reach the driver."""
    rows = texts.select("text").mapInArrow(_feature_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(1 << BITS)
    counts[rows["feature"].to_numpy()] += rows["n"].to_numpy()
    return np.log(counts / counts.sum())


def _weigher(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, weight = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                words = W.words_of(data, offsets, fold=True)
                text, feature = _features(words)
                size[row:end] = words.counts
                weight[row:end] = np.bincount(text, ratio[feature], minlength=end - row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("noise"), pa.array(size), pa.array(weight)],
                ["doc_id", "noise", "n_words", "log_weight"],
            )

    return run


def kth_largest(scored: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, exactly, by counting bins that narrow from pass to pass.

    Each pass sends at most 4096 counts to the driver; no pass sorts. None if there are fewer than k rows.
    """
    bins = 4096
    values = scored.select(F.col(column).alias("v"))
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if k > n:
        return None
    while low < high:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            break
        place = F.least(F.floor((F.col("v") - low) / step), F.lit(bins - 1))
        counts = values.where(F.col("v").between(low, high)).groupBy(place.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        ).collect()
        for r in sorted(counts, key=lambda r: -r.b):
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return high if k == 1 else low


def resampled(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", share: float = 0.5, seed: int = 7,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, log_weight, mean_ratio, gumbel_key, selected.

    ``selected`` marks the ``round(share * rows)`` rows with the largest keys
    (rows equal to the last one in its key, such as repeated rows, all count).
    ``mean_ratio`` is the log weight per word, a quality score that does not
    grow with length. The target model is fitted on at most TARGET_ROWS
    labelled rows, the first by the order of a hash; the raw model on every
    row. Null and empty texts have weight 0. Without good labels all ratios
    are those of a uniform target. An empty table gives no rows.
    """
    source = documents_of(docs, id_col, text_col)
    good = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where("label = 1 AND doc_id IS NOT NULL")
    order = F.md5(F.col("doc_id").cast("string"))
    ids = good.select("doc_id", order.alias("turn")).distinct().sort("turn", "doc_id").limit(TARGET_ROWS).select("doc_id")
    target = feature_model(source.join(F.broadcast(ids), "doc_id"))
    ratio = target - feature_model(source)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    kind = source.schema["doc_id"].dataType.simpleString()
    weighed = source.withColumn("noise", -F.log(-F.log(uniform))).mapInArrow(
        _weigher(ratio), f"doc_id {kind}, noise double, n_words long, log_weight double"
    )
    weighed = stored(weighed.withColumn("gumbel_key", F.col("log_weight") + F.col("noise")), "weights")
    k = math.floor(share * weighed.count() + 0.5)
    border = kth_largest(weighed, "gumbel_key", k) if k > 0 else math.inf
    return weighed.select(
        "doc_id", "n_words", "log_weight", F.coalesce(F.col("log_weight") / F.nullif("n_words", F.lit(0)), F.lit(0.0)).alias("mean_ratio"),
        "gumbel_key", (F.col("gumbel_key") >= F.lit(border)).alias("selected"),
    )
