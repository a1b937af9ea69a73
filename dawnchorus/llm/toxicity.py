"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more.

Two dictionaries are trained, one on toxic and one on ordinary text. Both end
with the same part, trained on ordinary text, so that common words cost the
same with either; before it stands a part of equal size, trained on pieces
that mark toxic texts in the one, on ordinary words in the other. Each window
of a text is compressed with both; the bytes that the toxic dictionary saves
in the two best windows are turned into a score by a logistic curve fitted on
labelled texts that the dictionaries have not seen. What counts as a marking
piece depends on how many texts there are: of the pairs of LEAST_TEXTS and
LEAST_ODDS the one that explains those texts best is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import documents_of

WINDOW = 12  # words
GRAM = 6  # bytes of a marking piece
LEAST_TEXTS = (2, 4, 8)  # toxic texts that must hold a marking piece
LEAST_ODDS = (1.5, 2.5, 3.5)  # log odds of a marking piece
BASE_BYTES, PART_BYTES = 32768, 2048
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24_000_000  # of each label: the bound of the fit
BASE_WORDS = 1_000_000  # ordinary words, drawn from all of the sample, that the common part is trained on


@dataclass(frozen=True)
class Model:
    """Raw contents of the two dictionaries and the logistic curve."""

    toxic: bytes
    ordinary: bytes
    offset: float
    slope: float


def _folded(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _padded(word: bytes) -> bytes:
    return b" " + word + b" "


def _grams(word: bytes) -> list[bytes]:
    padded = _padded(word)
    return [padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))]


def _dictionary(size: int, words: list[bytes]) -> bytes:
    """A zstandard dictionary trained on words; where they are too few for the trainer, the words themselves."""
    import zstandard

    samples = [b"".join(map(_padded, words[i : i + 8])) for i in range(0, len(words), 8)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted({_padded(w) for w in words}))[-size:]


def _compressor(content: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=15, search_log=4, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress


class Scorer:
    """Bytes saved by the toxic dictionary, over whole texts."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def saved(self, text: str) -> float:
        words = _folded(text)
        best = second = 0
        for i in range(0, len(words), WINDOW):
            window = _padded(b" ".join(words[i : i + WINDOW]))
            gain = len(self.ordinary(window)) - len(self.toxic(window))
            if gain > best:
                best, second = gain, best
            elif gain > second:
                second = gain
        return float(best + second)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one value, with a small ridge, by Newton steps."""
    design = np.stack([np.ones_like(x), x], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-3 * b
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(texts: list[tuple[str, int]], rate: float) -> Model:
    """Fit on (text, label) rows in a fixed order; ``rate`` is the share of label 1 among all labelled rows."""
    own = [(t, y) for i, (t, y) in enumerate(texts) if i % 3]
    rest = [(t, y) for i, (t, y) in enumerate(texts) if i % 3 == 0]
    toxic = [_folded(t) for t, y in own if y]
    ordinary = [_folded(t) for t, y in own if not y]
    if not toxic or not ordinary or len({y for _, y in rest}) < 2:
        return Model(b"", b"", -20.0 if rate < 0.5 else 20.0, 0.0)
    with_gram, without = Counter(), Counter()
    for counts, group in ((with_gram, toxic), (without, ordinary)):
        for words in group:
            counts.update({g for w in set(words) for g in _grams(w)})

    def odds(g: bytes) -> float:
        return math.log((with_gram[g] + 0.5) / (len(toxic) + 1)) - math.log((without[g] + 0.5) / (len(ordinary) + 1))

    plain = [w for words in ordinary for w in words]
    few = np.sort(np.random.default_rng(1).permutation(len(plain))[:BASE_WORDS])  # from the whole sample
    base = _dictionary(BASE_BYTES, [plain[i] for i in few])
    y = np.array([float(v) for _, v in rest])
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    best, least_loss = Model(b"", b"", -20.0 if rate < 0.5 else 20.0, 0.0), math.inf
    tried = set()
    for least_texts in LEAST_TEXTS:
        for least_odds in LEAST_ODDS:
            marks = frozenset(g for g, n in with_gram.items() if n >= min(least_texts, len(toxic)) and odds(g) >= least_odds)
            if not marks or marks in tried:
                continue
            tried.add(marks)
            dictionaries = _pair(base, toxic, marks, plain)
            if min(map(len, dictionaries)) < 8:
                continue
            scorer = Scorer(*dictionaries)
            x = np.array([scorer.saved(t) for t, _ in rest])
            offset, slope = _logistic(x, y, weight)
            margin = np.clip(offset + slope * x, -30, 30)
            loss = float((weight * np.logaddexp(0, np.where(y == 1, -margin, margin))).mean())
            if loss < least_loss:
                best, least_loss = Model(*dictionaries, offset, slope), loss
    return best


def _pair(base: bytes, toxic: list[list[bytes]], marks: frozenset[bytes], plain: list[bytes]) -> list[bytes]:
    """The toxic and the ordinary dictionary, of one size."""
    pieces = []
    for words in toxic:
        for w in words:
            at = [i for i, g in enumerate(_grams(w)) if g in marks]
            if at:
                pieces.append(_padded(w)[at[0] : at[-1] + GRAM].strip())
    chosen = np.random.default_rng(0).integers(0, len(plain), 3 * max(len(pieces), 500)) if plain else []
    parts = [_dictionary(PART_BYTES, pieces), _dictionary(PART_BYTES, [plain[i] for i in chosen])]
    size = min(map(len, parts))
    return [p[len(p) - size :] + base for p in parts]


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.toxic, model.ordinary) if model.toxic else None
        for batch in batches:
            saved = np.array([scorer.saved(t.as_py()) if scorer else 0.0 for t in batch.column("text")], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(model.offset + model.slope * saved, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(saved), pa.array(score)], ["doc_id", "bytes_saved", "score"]
            )

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str) -> tuple[list[tuple[str, int]], float]:
    """At most SAMPLE_ROWS texts and SAMPLE_BYTES of each label, by the order of a hash; share of label 1.

    ``docs`` has doc_id and text, ``labels`` doc_id and the label; the bounded
    list of ids is broadcast. A text that an id repeats counts once, whatever
    the number of its rows, and no more rows or bytes than that reach the driver.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rate = known.agg(F.avg("label")).first()[0]
    order = F.md5(F.col("doc_id").cast("string"))
    ids = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).select("doc_id", "label", order.alias("turn")).distinct()
        part = part.sort("turn", "doc_id").limit(SAMPLE_ROWS)
        ids = part if ids is None else ids.unionByName(part)
    digest = F.sha2("text", 256).alias("digest")
    sizes = docs.select("doc_id", digest, F.octet_length("text").alias("bytes")).join(F.broadcast(ids), "doc_id").distinct()
    kept = []
    for label in (0, 1):
        room = SAMPLE_BYTES
        for row in sizes.where(F.col("label") == label).sort("turn", "doc_id", "digest").limit(SAMPLE_ROWS).collect():
            if row.bytes <= room:
                room -= row.bytes
                kept.append((row.doc_id, row.digest, label, row.turn))
    if not kept:
        return [], float(rate or 0.0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame(kept, f"doc_id {kind}, digest string, label int, turn string")
    texts = docs.select("doc_id", "text", digest).join(F.broadcast(picked), ["doc_id", "digest"])
    rows = texts.dropDuplicates(["doc_id", "digest", "label"]).select("turn", "doc_id", "text", "label").collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.turn, r.doc_id, r.label, r.text))], float(rate)


def held_out_rows(doc_id, folds: int, fold: int):
    """True where crc32 of the id as text falls into the fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", folds: int = 5, fold: int = 0,
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5), bytes_saved.

    Dictionaries and curve are fitted on at most SAMPLE_ROWS rows and
    SAMPLE_BYTES of text of each label, none of them held out; every text is
    scored whole. Null and empty texts save nothing and get the lowest score.
    Without rows of both labels every score says the only label known (0
    where there is none). Repeated rows and ids get a row each.
    """
    source = documents_of(docs, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), label_col)
    known = known.where(~held_out_rows(F.col("doc_id"), folds, fold))
    model = fit(*labelled_sample(source, known, label_col))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(_scorer(model), f"doc_id {kind}, bytes_saved double, score double")
    return scored.select(
        "doc_id", held_out_rows(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "bytes_saved",
    )
