"""Embedding vectors: packing, unpacking, widening.

A packed vector is the base64 text of its float32 values in little-endian
byte order, without any header.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def feature_names(n: int) -> list[str]:
    return [f"f{i:04d}" for i in range(n)]


def as_float32(v: Column) -> Column:
    return v.cast("array<float>")


def require_float_vector(df: DataFrame, column: str) -> None:
    kind = df.schema[column].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        raise TypeError(f"{column} must be array<float>, got {kind.simpleString()}")


def _packer():
    @F.arrow_udf("string")
    def pack_batch(vectors: "pa.Array") -> "pa.Array":
        import base64

        import numpy as np
        import pyarrow as pa

        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        raw = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        ends = np.cumsum(sizes.astype("int64")) * 4
        starts = ends - sizes * 4
        valid = vectors.is_valid().to_pylist()
        return pa.array(
            [
                base64.b64encode(raw[a:b]).decode("ascii") if ok else None
                for a, b, ok in zip(starts.tolist(), ends.tolist(), valid)
            ],
            pa.string(),
        )

    return pack_batch


def _unpacker():
    @F.arrow_udf("array<float>")
    def unpack_batch(texts: "pa.Array") -> "pa.Array":
        import base64

        import numpy as np
        import pyarrow as pa

        blobs = [None if t is None else base64.b64decode(t) for t in texts.to_pylist()]
        if any(b is not None and len(b) % 4 for b in blobs):
            raise ValueError("a packed vector isn't a whole number of float32 values")
        values = np.frombuffer(b"".join(b for b in blobs if b is not None), dtype="<f4")
        offsets, at = [], 0
        for b in blobs:
            offsets.append(None if b is None else at)
            at += 0 if b is None else len(b) // 4
        offsets.append(at)
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(values.astype("float32"), pa.float32())
        )

    return unpack_batch


def pack(df: DataFrame, column: str, into: str = "embeddings") -> DataFrame:
    """Add ``into``: the packed text of ``column``, which must be array<float>."""
    require_float_vector(df, column)
    return df.withColumn(into, _packer()(F.col(column)))


def unpack(df: DataFrame, column: str, into: str = "embedding") -> DataFrame:
    """Add ``into``: the vector packed in ``column``."""
    if df.schema[column].dataType.typeName() != "string":
        raise TypeError(f"{column} must be a packed string")
    return df.withColumn(into, _unpacker()(F.col(column)))


def widths(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest vector length, as one row."""
    size = F.when(F.col(column).isNotNull(), F.size(column))
    return df.agg(
        F.min(size).alias("min_width"),
        F.max(size).alias("max_width"),
        F.count(size).alias("n_vectors"),
    )


def uniform_width(df: DataFrame, column: str) -> int:
    """The common vector length; ragged vectors are an error."""
    row = widths(df, column).first()
    if row["min_width"] != row["max_width"]:
        raise ValueError(
            f"{column} holds vectors of different lengths: {row['min_width']} to {row['max_width']}"
        )
    return row["max_width"] or 0


def widen(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """One float column per vector element, after the other columns.

    Without ``n`` the width of one vector is taken. A vector of another length
    fails the job that evaluates the result, and with it the write; scanning
    all vectors beforehand would read the largest column twice.
    """
    if n is None:
        n = first_width(df, column)
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    cells = [F.get(F.col("__v"), F.lit(i)).cast("float").alias(name) for i, name in enumerate(feature_names(n))]
    checked = df.withColumn("__v", of_width(F.col(column), n, f"{column} has a vector of another length than {n}"))
    return checked.select(*rest, *cells)


def of_width(v: Column, n: int, message: str) -> Column:
    """The vector itself; one of another length fails the running job."""
    return F.when(F.size(v) == n, v).when(v.isNotNull(), F.raise_error(F.lit(message)).cast("array<float>"))


def first_width(df: DataFrame, column: str) -> int:
    row = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
    return row["n"] if row else 0


def narrow(df: DataFrame, metadata=("channel", "offset"), into: str = "embeddings") -> DataFrame:
    """Feature columns, in column order, to one packed column after ``metadata``."""
    absent = [c for c in metadata if c not in df.columns]
    if absent:
        raise ValueError(f"metadata columns are not in the table: {absent}")
    features = [F.col(f"`{c}`").cast("float") for c in df.columns if c not in metadata]
    vector = F.array(*features) if features else F.array().cast("array<float>")
    return pack(df.select(*metadata, vector.alias("__v")), "__v", into).drop("__v")


def unpack_wide(df: DataFrame, column: str = "embeddings", n: int | None = None) -> DataFrame:
    """A packed column replaced by one float column per element."""
    if column not in df.columns:
        raise ValueError(f"packed column is not in the table: {column}")
    return widen(unpack(df, column, "__v").drop(column), "__v", n)
