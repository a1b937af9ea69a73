"""Language mixtures: expectation-maximisation over the segments of a text, language set by penalised likelihood.

Each language is a smoothed distribution of hashed byte n-grams, counted over
all texts that may be learned from. A text is cut into segments of about
``SEGMENT`` bytes. Per text, expectation-maximisation finds the proportions of
languages that make its segments likeliest; the sets of its one, two, ...
strongest languages are compared by likelihood less a penalty for each
further language, and the best set counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm import words as W
from dawnchorus.llm.common import documents_of
from dawnchorus.llm.toxicity import held_out_rows

GRAM, BITS, SEGMENT, ROUNDS = 4, 16, 64, 12
PENALTY = 3.0  # of a further language, times the logarithm of the number of segments
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_LOWER[ord("0") : ord("9") + 1] = ord("0")


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that ends at each byte; shorter ones at the start of each text, none reaches over it."""
    codes = _LOWER[data]
    packed = codes.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, GRAM):
        packed[k:] |= np.where(place[k:] >= k, codes[:-k] << np.uint32(8 * k), np.uint32(0))
    return (packed * np.uint32(2654435769)) >> np.uint32(32 - BITS)


def _counter(languages: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(languages).to_pylist(), dtype=object)
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                grams = _grams(data, offsets)
                for lang in set(langs[row:end]):
                    held = counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                    own = np.repeat(langs[row:end] == lang, np.diff(offsets))
                    held += np.bincount(grams[own], minlength=1 << BITS)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["lang", "gram", "n"]
            )

    return run


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each hashed n-gram: (n-grams, languages).

    ``docs`` has text and lang. Counts are summed by Spark; at most 2**BITS numbers a language reach the driver.
    """
    counted = docs.select("lang", "text").where("lang IS NOT NULL").mapInArrow(_counter("lang"), "lang string, gram long, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(rows["lang"].to_pylist(), dtype=object)
    names = sorted(set(langs))
    table = np.zeros((1 << BITS, len(names)))
    for k, name in enumerate(names):
        own = langs == name
        table[rows["gram"].to_numpy()[own], k] = rows["n"].to_numpy()[own]
    table += 0.5
    return names, (np.log(table) - np.log(table.sum(axis=0))).astype(np.float32)


def mixtures(likely: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood per text, for segment log likelihoods and the languages allowed to each text."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    top = likely.max(axis=1, keepdims=True)
    weight = np.exp(likely - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = weight * share[text] + 1e-300
        share = np.add.reduceat(part / part.sum(axis=1, keepdims=True), first[:-1], axis=0) / n[:, None]
        share = share * allowed
        share /= share.sum(axis=1, keepdims=True)
    fit = np.log((weight * share[text]).sum(axis=1) + 1e-300) + top[:, 0]
    return share, np.add.reduceat(fit, first[:-1])


def choose(likely: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: strongest language, its proportion, and proportions within the chosen set.

    Each text's set grows by its next strongest language for as long as that pays, whatever its neighbours do.
    """
    texts, count = len(first) - 1, likely.shape[1]
    free, _ = mixtures(likely, first, np.ones((texts, count)))
    rank = np.argsort(np.argsort(-free, axis=1, kind="stable"), axis=1, kind="stable")
    penalty = PENALTY * np.log(np.diff(first) + 1.0)
    best, chosen, growing = np.full(texts, -np.inf), np.zeros((texts, count)), np.ones(texts, dtype=bool)
    for size in range(1, count + 1):
        share, fit = mixtures(likely, first, (rank < size).astype(float))
        value = fit - penalty * (size - 1)
        growing &= value > best
        if not growing.any():
            break
        best[growing], chosen[growing] = value[growing], share[growing]
    strongest = chosen.argmax(axis=1)
    return strongest, free[np.arange(texts), strongest], chosen


def _predictor(names: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, sets = np.full(n, UNKNOWN, dtype=object), np.zeros(n), [""] * n
            for row, _, data, offsets in W.text_slices(batch.column("text")):
                some = np.flatnonzero(np.diff(offsets))
                if not len(some) or not names:
                    continue
                size = -(-np.diff(offsets)[some] // SEGMENT)
                first = np.concatenate([[0], np.cumsum(size)])
                text = np.repeat(np.arange(len(some)), size)
                at = offsets[some][text] + (np.arange(first[-1]) - first[text]) * SEGMENT
                likely = np.add.reduceat(table[_grams(data, offsets)], at, axis=0).astype(np.float64) / GRAM
                strongest, share, chosen = choose(likely, first)
                for i, t in enumerate(some):
                    lang[row + t] = names[strongest[i]]
                    sets[row + t] = ",".join(f"{names[k]}:{chosen[i, k]:.3f}" for k in np.flatnonzero(chosen[i] >= 5e-4))
                score[row + some] = share
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("has_letter"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets)],
                ["doc_id", "has_letter", "lang_pred", "score", "languages"],
            )

    return run


def languages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1), languages (the chosen set with proportions).

    Learned from text and language of the rows that are not held out. ``score``
    is the proportion of the predicted language among all languages. A null
    text, or one without a letter, is ``und`` with score 0 and an empty set, and
    so is every text where there is no language to learn. Repeated rows and
    ids get a row each.
    """
    known = docs.select(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        held_out_rows(F.col(f"`{id_col}`"), folds, fold).alias("held_out"),
    )
    names, table = learn(known.where("NOT held_out"))
    source = documents_of(docs, id_col, text_col).withColumn("has_letter", F.col("text").rlike(r"\p{L}"))
    kind = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInArrow(
        _predictor(names, table), f"doc_id {kind}, has_letter boolean, lang_pred string, score double, languages string"
    )
    sure = F.col("has_letter")
    return found.select(
        "doc_id", held_out_rows(F.col("doc_id"), folds, fold).alias("held_out"),
        F.when(sure, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(sure, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(sure, F.col("languages")).otherwise(F.lit("")).alias("languages"),
    )
