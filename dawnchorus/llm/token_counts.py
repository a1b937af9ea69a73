"""Token counts through a digest cache: a text is encoded once per content and tokenizer version.

The cache is a Parquet folder of (content, tokenizer, n_tokens): the SHA-256
of the normalised text, and of the tokenizer's file. Distinct contents that
the cache lacks are encoded and appended; every row then takes its count from
the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.llm.common import documents_of

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
_GROUP = 256  # texts given to the tokenizer at a time


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def piece_encoder(path: str):
    """Counts of a sentencepiece model: no begin or end token, no special tokens added."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    return load


def json_encoder(path: str):
    """Counts of a tokenizers file: no special tokens added, no truncation, no padding."""

    def load():
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]

    return load


def _encoder(load):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load()
        for batch in batches:
            texts = batch.column("text")
            counts: list[int] = []
            for at in range(0, batch.num_rows, _GROUP):
                counts += count(texts.slice(at, _GROUP).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """Counts stored for one tokenizer version, once per content; an absent folder is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "content string, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(folder).where(F.col("tokenizer") == tokenizer)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, cache: str, *, tokenizer: str, load, id_col: str = "doc_id", text_col: str = "text",
    normalise=None, limit: int = 4096,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the version digest, ``load()`` returns a function from
    texts to counts inside a task, ``cache`` a folder all executors share.
    Misses are encoded and appended when this is called; a second call finds
    them. ``normalise`` maps the text column before digest and encoding; by
    default a text stays as it is, so that counts are those of the text given.
    Null is the empty text, which has no tokens. Copies are encoded once.
    Concurrent or repeated appends of one content are harmless.
    """
    spark = docs.sparkSession
    source = documents_of(docs, id_col, text_col)
    text = F.col("text") if normalise is None else F.coalesce(normalise(F.col("text")), F.lit(""))
    keyed = source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(text, 256).alias("content"), text.alias("text"))
    misses = (
        keyed.select("content", "text").dropDuplicates(["content"])
        .join(read_cache(spark, cache, tokenizer), "content", "left_anti")
    )
    counted = misses.mapInArrow(_encoder(load), "content string, n_tokens long")
    counted.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return (
        keyed.select("doc_id", "n_bytes", "content")
        .join(read_cache(spark, cache, tokenizer), "content")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
