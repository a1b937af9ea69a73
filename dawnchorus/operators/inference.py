"""Batch application of a caller-supplied model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def infer(
    shards: DataFrame,
    load_model: Callable[[], Callable],
    audio: str,
    keys: list[str],
    with_logits: bool = False,
    logits_key: str = "label",
    batch_size: int | None = None,
    frames: Callable[[int], int] | None = None,
    length: int | None = None,
) -> DataFrame:
    """Run a model over shards; ``load_model`` is called once per Python worker task.

    Without ``batch_size`` the model is called per shard: ``model(samples) ->
    None | (embeddings, logits)`` where embeddings has the shape (time,
    channels, dim) and logits is a dict of arrays (time, classes) or (time,
    channels, classes), or None.

    With ``batch_size`` it is called once per that many shards of a task, in
    blocks of one shape: ``model(samples[batch, n]) -> None | (embeddings,
    logits)`` with a batch axis before all others. Shards are padded with
    silence to ``length`` samples (the longest of the block if not given), the last
    block of a task with silent shards, whose output is dropped. ``frames(n)``
    tells how many leading frames belong to a shard of ``n`` samples; without it
    all do.

    A shard without samples, or for which the model returns None, gives no
    row. ``logits_key`` names the logits to keep; the first entry is used where
    it is absent. The result has ``keys``, ``t``, ``channel``, ``embedding``
    and, only if asked for, ``logits``: an unused logit vector is never sent to
    the JVM.
    """
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    key_fields = ", ".join(f"`{k}` {shards.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_fields}, t int, channel int, embedding array<float>"
    if with_logits:
        schema += ", logits array<float>"
    wanted = logits_key if with_logits else None

    def heard(batches):
        """Key columns and samples of every shard that has any."""
        for batch in batches:
            samples = batch.column(audio)
            for at in range(batch.num_rows):
                if samples[at].is_valid:
                    head = [batch.column(k).slice(at, 1) for k in keys]
                    yield head, samples[at].values.to_numpy(zero_copy_only=False).astype("float32")

    def one_by_one(batches):
        model = load_model()
        for head, samples in heard(batches):
            outcome = model(samples)
            if outcome is not None and outcome[0] is not None:
                yield _rows_of(head, keys, *outcome, wanted)

    def in_blocks(batches):
        from itertools import batched

        model = load_model()
        for block in batched(heard(batches), batch_size):
            outcome = model(_padded([samples for _, samples in block], batch_size, length))
            if outcome is None or outcome[0] is None:
                continue
            embeddings, logits = outcome
            for at, (head, samples) in enumerate(block):
                n = embeddings.shape[1] if frames is None else min(frames(len(samples)), embeddings.shape[1])
                own = {name: values[at, :n] for name, values in logits.items()} if logits else logits
                yield _rows_of(head, keys, embeddings[at, :n], own, wanted)

    return shards.select(*keys, audio).mapInArrow(one_by_one if batch_size is None else in_blocks, schema)


def _padded(shards, rows, length):
    """Shards as the first rows of a block of zeros."""
    import numpy as np

    longest = max(len(s) for s in shards)
    if length is not None and longest > length:
        raise ValueError(f"a shard has {longest} samples, more than the block's {length}")
    block = np.zeros((rows, longest if length is None else length), dtype="float32")
    for at, samples in enumerate(shards):
        block[at, : len(samples)] = samples
    return block


def _lists(grid):
    """The last axis of an array as an Arrow list column, one list per cell of the other axes."""
    import numpy as np
    import pyarrow as pa

    flat = np.ascontiguousarray(grid, dtype="float32").reshape(-1)
    cells = flat.size // grid.shape[-1] if grid.shape[-1] else int(np.prod(grid.shape[:-1]))
    borders = np.arange(cells + 1, dtype="int32") * grid.shape[-1]
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))


def _rows_of(head, keys, embeddings, logit_sets, logits_key):
    """One shard's output as a record batch: time by time, within it channel by channel."""
    import numpy as np
    import pyarrow as pa

    grid = np.asarray(embeddings, dtype="float32")
    times, channels = grid.shape[:2]
    t, channel = np.divmod(np.arange(times * channels, dtype="int32"), max(channels, 1))
    origin = pa.array(np.zeros(times * channels, dtype="int64"))
    columns = [*[h.take(origin) for h in head], pa.array(t), pa.array(channel), _lists(grid)]
    names = [*keys, "t", "channel", "embedding"]
    if logits_key is not None:
        names.append("logits")
        if logit_sets:
            scores = np.asarray(logit_sets.get(logits_key, next(iter(logit_sets.values()))), dtype="float32")
            if scores.ndim == 2:  # one row of logits for all channels of a time
                scores = np.broadcast_to(scores[:, None], (times, channels, scores.shape[-1]))
            columns.append(_lists(scores))
        else:
            columns.append(pa.nulls(times * channels, pa.list_(pa.float32())))
    return pa.RecordBatch.from_arrays(columns, names)
