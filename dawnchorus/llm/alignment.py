"""Alignment of two tokenizers' tokens on the bytes they share.

Token bytes of both tokenizers spell the same text, so the byte offsets at
which tokens of both end cut the two streams into groups. A fragment is a run
of both streams with its cuts: an open prefix, closed groups, an open suffix.
Fragments of neighbouring byte ranges compose: the left one's suffix and the
right one's prefix become one run, cut again at the ends they now share; all
other groups stay. Composition is associative, with the empty fragment as
neutral element, so the parts of a very long text are encoded by different
tasks and put together as a tree.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import stored

PART_CHARS = 1 << 16  # longer texts are encoded in parts
FAN_IN = 8  # fragments composed at a time
BLOCK_LINKS = 1 << 20  # distinct links of documents that share a list of pairs
_ENCODE_CHARS = 1 << 19  # characters of texts put together at a time

# A tokenizer never joins a character that is no white space with white space that follows it,
# so a text may be cut there: before a space or line end, or only before a space that something follows.
_CUT_A = re.compile(r"(?<=\S)(?=[ \n])")
_CUT_B = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
#: How byte-level BPE cuts a text before merging. A fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_REMEMBERED = 150_000  # words of which the ids are kept; beyond it the half met most often
_SIDE_BY_SIDE = 2_000  # new words given to a tokenizer at a time


@functools.cache
def byte_level(path: str):
    """A byte-level BPE file of the tokenizers library: (text -> ids, bytes of every id).

    The file's vocabulary and pattern are run by tiktoken, which is several times faster and
    needs no object per token. It merges by lowest id, so the file's merges
    must be in the order of their ids, and nothing but the byte-level pattern may cut the text.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told["pre_tokenizer"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes shown as themselves
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    ids = {p: i for p, i in model["vocab"].items() if p not in special}
    merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    fit = merged == sorted(merged) and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if not fit or told["normalizer"] is not None:
        raise ValueError(f"{path} isn't a plain byte-level BPE with merges in the order of their ids")
    ranks = {bytes(shown[c] for c in p): i for p, i in ids.items()}
    coder = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for piece, at in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        pieces[at] = piece
    return lambda text: coder.encode_to_numpy(text, disallowed_special=()).astype(np.int32), pieces


@functools.cache
def piece_model(path: str):
    """A sentencepiece file with byte fallback, which puts a space first: (space and text -> ids or None, bytes of every id).

    No piece holds a space after another character. None stands for a text that the ids don't spell.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = model.id_to_piece(list(range(model.get_piece_size())))
    if any("▁" in p.lstrip("▁") for p in names):
        raise ValueError(f"{path} has pieces with a space inside")
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(text: str) -> np.ndarray | None:
        if not text:
            return np.zeros(0, np.int32)
        ids = model.encode(text[1:])
        return np.array(ids, np.int32) if b"".join([pieces[i] for i in ids]) == text.encode() else None

    return encode, pieces


@dataclass
class Fragment:
    """Tokens of a byte range; ``sizes_*`` are tokens per run: open prefix, closed groups, open suffix.

    A fragment without a shared end is a single open run. ``shift`` says how
    many bytes later than B's stream A's begins. In a whole text the prefix is
    the first group and the suffix is empty.
    """

    a: np.ndarray
    b: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    shift: int = 0

    @property
    def closed(self) -> bool:
        return len(self.sizes_a) > 1


def cut(a: np.ndarray, b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray, shift: int = 0) -> Fragment:
    """The fragment of two token runs, cut wherever tokens of both end."""
    ends_a, ends_b = np.cumsum(lengths_a[a]) + shift, np.cumsum(lengths_b[b])
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    sizes = [np.diff(np.searchsorted(e, shared, "right"), prepend=0, append=len(e)) for e in (ends_a, ends_b)]
    return Fragment(a, b, *sizes, shift)


def composed(x: Fragment, y: Fragment, lengths_a: np.ndarray, lengths_b: np.ndarray) -> Fragment:
    """``x`` followed by ``y``."""
    at_a, at_b = len(x.a) - x.sizes_a[-1], len(x.b) - x.sizes_b[-1]
    a, b = np.concatenate([x.a, y.a]), np.concatenate([x.b, y.b])
    inner = cut(
        a[at_a : len(x.a) + y.sizes_a[0]], b[at_b : len(x.b) + y.sizes_b[0]], lengths_a, lengths_b, 0 if x.closed else x.shift
    )
    upto = -1 if y.closed else None  # a closed right side ends the joined run itself
    sizes_a = np.concatenate([x.sizes_a[:-1], inner.sizes_a[:upto], y.sizes_a[1:]])
    return Fragment(a, b, sizes_a, np.concatenate([x.sizes_b[:-1], inner.sizes_b[:upto], y.sizes_b[1:]]), x.shift)


def _lengths(pieces: list[bytes]) -> np.ndarray:
    return np.array([len(p) for p in pieces], dtype=np.int64)


def whole_fragment(text_a: str, text_b: str, path_a: str, path_b: str, shift: int = 0) -> Fragment | None:
    """The fragment of a text, or of a part with its own range for either tokenizer; None if the tokens don't spell it."""
    (encode_a, pieces_a), (encode_b, pieces_b) = byte_level(path_a), piece_model(path_b)
    a, b = encode_a(text_a), encode_b(text_b)
    if b is None or b"".join([pieces_a[i] for i in a.tolist()]) != text_a.encode():
        return None
    return cut(a, b, *_both_lengths(path_a, path_b), shift)


@functools.cache
def _both_lengths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    return _lengths(byte_level(path_a)[1]), _lengths(piece_model(path_b)[1])


class Words:
    """Fragments of texts, put together from those of their words; frequent words are remembered.

    Tokens of both end before a single space, unless white space stands on both of its sides, so a text's
    ids and groups are those of its words, each with the space before it. Texts with
    spaces side by side, at the end, or before other white space are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        self.paths = path_a, path_b
        self.at: dict[str, int] = {}  # place of a word
        self.met = np.zeros(0, np.int64)  # how often, of late
        self.sizes = np.zeros((4, 0), np.int32)  # lengths of a word's a, b, sizes_a, sizes_b; none of a word that can't be put together
        self.lists = [np.zeros(0, np.int32)] * 4  # those of all words, one after the other

    def fragments(self, texts: list[str]) -> list[Fragment | None]:
        """Of texts that begin with a space; None for those that the tokens don't spell."""
        plain = [None if "  " in t or t[-1:] in ("", " ") else t[1:].split(" ") for t in texts]
        words = [w for ws in plain if ws is not None for w in ws]
        if not words:
            return [whole_fragment(t, t, *self.paths) for t in texts]
        self._learn([*set(words).difference(self.at)])
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([len(ws) for ws in plain if ws is not None])
        self.met += np.bincount(at, minlength=len(self.met))
        starts = np.cumsum(self.sizes, axis=1, dtype=np.int64) - self.sizes
        joined, upto = [], []
        for values, first, size in zip(self.lists, starts, self.sizes, strict=True):
            n = size[at].astype(np.int64)
            total = np.cumsum(n)
            joined.append(values[np.repeat(first[at] - (total - n), n) + np.arange(total[-1])])
            upto.append([0, *total[ends - 1].tolist()])
        bad = np.concatenate([[0], np.cumsum(self.sizes[0][at] == 0)])[[0, *ends]]
        out, k = [], 0
        for text, own in zip(texts, plain, strict=True):
            k += own is not None
            if own is None or bad[k] > bad[k - 1]:
                out.append(whole_fragment(text, text, *self.paths))
            else:
                a, b, sizes_a, sizes_b = (x[u[k - 1] : u[k]] for x, u in zip(joined, upto, strict=True))
                out.append(Fragment(a, b, np.append(sizes_a, np.int32(0)), np.append(sizes_b, np.int32(0))))
        self._forget()
        return out

    def _forget(self) -> None:
        """Only the words met most often are kept when there are too many."""
        if len(self.at) <= _REMEMBERED:
            return
        kept = np.sort(np.argsort(-self.met, kind="stable")[: _REMEMBERED // 2])
        place = np.full(len(self.met), -1)
        place[kept] = np.arange(len(kept))
        self.at = {w: k for w, i in self.at.items() if (k := int(place[i])) >= 0}
        self.lists = [x[np.repeat(place >= 0, n)] for x, n in zip(self.lists, self.sizes, strict=True)]
        self.sizes, self.met = self.sizes[:, kept], self.met[kept] // 2

    def _learn(self, words: list[str]) -> None:
        learned = [x for low in range(0, len(words), _SIDE_BY_SIDE) for x in self._encoded(words[low : low + _SIDE_BY_SIDE])]
        if not learned:
            return
        for words, _, _ in learned:
            self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.sizes = np.concatenate([self.sizes, *(n for _, n, _ in learned)], axis=1)
        self.met = np.concatenate([self.met, np.zeros(len(self.at) - len(self.met), np.int64)])
        self.lists = [np.concatenate([x, *(y[k] for _, _, y in learned)]) for k, x in enumerate(self.lists)]

    def _encoded(self, words: list[str]) -> list[tuple[list[str], np.ndarray, list[np.ndarray]]]:
        """Words with their sizes and lists, encoded side by side as one text; where that fails, in halves."""
        odd = [w for w in words if w[0].isspace()]
        words = [w for w in words if not w[0].isspace()]
        text = " " + " ".join(words)
        found = whole_fragment(text, text, *self.paths) if words else None
        if found is None and len(words) > 1:
            half = len(words) // 2
            return [*self._encoded(words[:half]), *self._encoded(words[half:] + odd)]
        nothing = [np.zeros(0, np.int32)] * 4
        if found is None:
            return [(odd + words, np.zeros((4, len(odd + words)), np.int32), nothing)]
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        lengths = _both_lengths(*self.paths)
        ends_a, ends_b = np.cumsum(lengths[0][found.a]), np.cumsum(lengths[1][found.b])
        sizes_a, sizes_b = found.sizes_a[:-1].astype(np.int32), found.sizes_b[:-1].astype(np.int32)
        groups = np.searchsorted(ends_a[np.cumsum(sizes_a) - 1], ends, "right")  # a word's end is a group's end
        upto = np.stack([np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right"), groups, groups])
        sizes = np.diff(upto, axis=1, prepend=0).astype(np.int32)
        return [(words, sizes, [found.a, found.b, sizes_a, sizes_b]), (odd, np.zeros((4, len(odd)), np.int32), nothing)]


@functools.cache
def _words(path_a: str, path_b: str) -> Words:
    return Words(path_a, path_b)


def _fields(id_type: str) -> str:
    return (
        f"key string, doc_id {id_type}, part int, parts int, valid boolean, shift long, "
        "a array<int>, b array<int>, sizes_a array<int>, sizes_b array<int>"
    )


_PARTS = "key string, doc_id {}, part int, parts int, text string, a_from int, a_to int, b_from int, b_to int, shift long"


def _parted(size: int, id_type: pa.DataType):
    """Parts of texts, each with the ranges of it that either tokenizer encodes."""

    def places(rule, text):
        found = [0]
        for start in range(size, len(text), size):
            hit = rule.search(text, max(start, found[-1] + 1))
            found.append(hit.start() if hit else len(text))
        return [*found, len(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, key = " " + batch.column("text")[row].as_py(), uuid.uuid4().hex
                a, b = places(_CUT_A, text), places(_CUT_B, text)
                shift = 0
                for k in range(len(a) - 1):
                    low, high = min(a[k], b[k]), max(a[k + 1], b[k + 1])
                    values = [key, None, k, len(a) - 1, text[low:high], a[k] - low, a[k + 1] - low, b[k] - low, b[k + 1] - low, shift]
                    arrays = [pa.array([v]) for v in values]
                    arrays[1] = batch.column("doc_id").slice(row, 1)
                    yield pa.RecordBatch.from_arrays(
                        [x.cast(t) for x, t in zip(arrays, _part_types(id_type), strict=True)],
                        ["key", "doc_id", "part", "parts", "text", "a_from", "a_to", "b_from", "b_to", "shift"],
                    )
                    shift += len(text[a[k] : a[k + 1]].encode()) - len(text[b[k] : b[k + 1]].encode())

    return run


def _part_types(id_type: pa.DataType) -> list[pa.DataType]:
    return [pa.string(), id_type, pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.int64()]


def _encoded(path_a: str, path_b: str):
    """Fragments of texts or of parts of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _words(path_a, path_b)
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            group = (np.cumsum(sizes) - sizes) // _ENCODE_CHARS  # runs of rows of about that many characters
            borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for low, high in zip(borders, borders[1:], strict=False):
                if low == high:
                    continue
                rows = batch.slice(low, high - low)
                texts, *ranges = [rows.column(c).to_pylist() for c in ("text", "a_from", "a_to", "b_from", "b_to", "shift")]
                found: list[Fragment | None] = [None] * len(texts)
                same = []  # rows of which both tokenizers take one range that begins with a space
                for k, (text, a_from, a_to, b_from, b_to, shift) in enumerate(zip(texts, *ranges, strict=True)):
                    if (a_from, a_to) == (b_from, b_to) and shift == 0 and text[a_from : a_from + 1] == " ":
                        same.append((k, text[a_from:a_to]))
                    else:
                        found[k] = whole_fragment(text[a_from:a_to], text[b_from:b_to], path_a, path_b, shift)
                for (k, _), f in zip(same, memory.fragments([t for _, t in same]), strict=True):
                    found[k] = f
                # what can't be spelled is an empty run
                none = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32)
                keep = [rows.column(c) for c in ("key", "doc_id", "part", "parts")]
                shown = [f or Fragment(*none, shift) for f, shift in zip(found, ranges[-1], strict=True)]
                yield _batch(keep, [f is not None for f in found], shown)

    return run


def _batch(keep: list[pa.Array], valid: list[bool], found: list[Fragment]) -> pa.RecordBatch:
    def lists(name):
        values = [getattr(f, name) for f in found]
        borders = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(values).astype(np.int32)))

    arrays = [*keep, pa.array(valid), pa.array([f.shift for f in found], pa.int64()), *[lists(c) for c in ("a", "b", "sizes_a", "sizes_b")]]
    return pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "part", "parts", "valid", "shift", "a", "b", "sizes_a", "sizes_b"])


def _ints(column: pa.ChunkedArray | pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _fragment(table: pa.Table | pa.RecordBatch, row: int) -> Fragment:
    lists = [_ints(table.column(c), row) for c in ("a", "b", "sizes_a", "sizes_b")]
    return Fragment(*lists, table.column("shift")[row].as_py())


def _reduced(path_a: str, path_b: str):
    """Neighbouring fragments of one text as one fragment."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        lengths = _lengths(byte_level(path_a)[1]), _lengths(piece_model(path_b)[1])
        whole = functools.reduce(lambda x, y: composed(x, y, *lengths), (_fragment(table, i) for i in range(table.num_rows)))
        first = table.slice(0, 1).combine_chunks()
        part, parts = first["part"][0].as_py() // FAN_IN, -(-first["parts"][0].as_py() // FAN_IN)
        keep = [first["key"].chunk(0), first["doc_id"].chunk(0), pa.array([part], pa.int32()), pa.array([parts], pa.int32())]
        return pa.Table.from_batches([_batch(keep, [all(table["valid"].to_pylist())], [whole])])

    return run


def _sources(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, part_chars: int) -> tuple[DataFrame, DataFrame]:
    """Texts to be encoded whole, and fragments composed of the parts of longer ones."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    size = F.char_length("text")
    zero, one = F.lit(0), F.lit(1)
    whole = source.where(size <= part_chars).select(
        F.lit("").alias("key"), "doc_id", zero.alias("part"), one.alias("parts"), F.concat(F.lit(" "), "text").alias("text"),
        zero.alias("a_from"), (size + 1).alias("a_to"), zero.alias("b_from"), (size + 1).alias("b_to"), zero.cast("long").alias("shift"),
        size.alias("size"),
    )
    parts = source.where(size > part_chars).mapInArrow(_parted(part_chars, _arrow_type(docs, id_col)), _PARTS.format(id_type))
    parts = stored(parts, "alignment-parts")
    sized = parts.withColumn("size", F.char_length("text")).repartition("key", "part")
    long = sized.mapInArrow(_encoded(path_a, path_b), _fields(id_type))
    most = parts.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        long = long.groupBy("key", F.expr(f"part div {FAN_IN}").alias("run")).applyInArrow(_reduced(path_a, path_b), _fields(id_type))
        most = -(-most // FAN_IN)
    return whole, long


def alignments(
    docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS
) -> DataFrame:
    """The aligned tokens of every row of ``docs``: doc_id, valid, a, b, sizes_a, sizes_b, as a lazy table.

    ``a`` are the ids of the byte-level file ``path_a`` for a space and the
    text, ``b`` those of the sentencepiece file ``path_b`` for the text, to
    which it adds that space. ``sizes_*`` count either side's tokens per group,
    before an empty last run. Where the token bytes differ
    from the text, or it is null or empty, ``valid`` is false and there are
    no tokens. Repeated or null ids are rows of their own.

    Texts over ``part_chars`` are written in parts to the shared folder when
    this is called, encoded part by part and composed in rounds of ``FAN_IN``;
    a run of that many characters without a space stays in one part.
    """
    whole, long = _sources(docs, path_a, path_b, id_col, text_col, part_chars)
    short = whole.mapInArrow(_encoded(path_a, path_b), _fields(docs.schema[id_col].dataType.simpleString()))
    found = short.unionByName(long)
    return found.select("doc_id", (F.col("valid") & (F.size("a") > 0)).alias("valid"), "a", "b", "sizes_a", "sizes_b")


def _arrow_type(docs: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[name].dataType)


def links(found: Fragment, lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all token pairs whose byte ranges overlap."""
    ends_a, ends_b = np.cumsum(lengths_a[found.a]), np.cumsum(lengths_b[found.b])
    low = np.searchsorted(ends_b, ends_a - lengths_a[found.a], "right")
    n = np.searchsorted(ends_b, ends_a, "left") - low + 1
    at_a = np.repeat(np.arange(len(n)), n)
    return at_a, low[at_a] + np.arange(len(at_a)) - (np.cumsum(n) - n)[at_a]


def id_texts(n_a: int, n_b: int) -> pa.Array:
    """Decimal ids with the sign that follows: A's inside and at the end of a run, then B's likewise."""
    return pa.array([f"{i}{sign}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for sign in signs for i in range(n)])


def groups_text(found: Fragment, texts: pa.Array, n_a: int, n_b: int) -> memoryview:
    """``a1,a2|b1;a3|b2,b3``: decimal ids, groups in order."""
    sizes_a, sizes_b = found.sizes_a[:-1], found.sizes_b[:-1]
    before_a, before_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    out = np.empty(len(found.a) + len(found.b), dtype=np.int32)
    for ids, sizes, before, others, first, n in (
        (found.a, sizes_a, before_a, before_b, 0, n_a), (found.b, sizes_b, before_b, before_a + sizes_a, 2 * n_a, n_b),
    ):
        which = ids + np.int32(first)
        which[before + sizes - 1] += n
        out[np.arange(len(ids)) + np.repeat(others, sizes)] = which
    body = texts.take(pa.array(out))
    return memoryview(body.buffers()[2])[: int(np.frombuffer(body.buffers()[1], np.int32)[len(out)]) - 1]


_DOCS = "block string, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, pairs array<long>, docs array<long>"


def _blocks(path_a: str, path_b: str, id_type: pa.DataType):
    """Documents with their distinct links, as steps through the block's sorted pairs; one row more per block lists those pairs.

    A pair is A's id times B's vocabulary plus B's id.
    """
    schema = pa.schema(
        [("block", pa.string()), ("doc_id", id_type), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]]
        + [("groups_sha256", pa.string()), *[(c, pa.list_(pa.int32())) for c in ("steps", "times")]]
        + [(c, pa.list_(pa.int64())) for c in ("pairs", "docs")]
    )

    def block(rows):
        name = uuid.uuid4().hex
        pairs, at = np.unique(np.concatenate([r[-2] for r in rows]), return_inverse=True)
        docs = np.bincount(at, minlength=len(pairs))
        ends = np.cumsum([len(r[-2]) for r in rows])
        out = [
            (name, *r[:-2], np.diff(at[end - len(r[-2]) : end], prepend=0).astype(np.int32), r[-1].astype(np.int32), None, None)
            for r, end in zip(rows, ends, strict=True)
        ]
        out.append((name, None, None, None, None, None, None, None, None, pairs, docs))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_a, pieces_b = byte_level(path_a)[1], piece_model(path_b)[1]
        lengths_a, lengths_b = _lengths(pieces_a), _lengths(pieces_b)
        texts = id_texts(len(pieces_a), len(pieces_b))
        held, n = [], 0
        nothing = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                doc = batch.column("doc_id")[row].as_py()
                if not batch.column("valid")[row].as_py() or not len(batch.column("a")[row]):
                    held.append((doc, 0, 0, 0, 0, "", nothing, nothing))
                else:
                    f = Fragment(*[_ints(batch.column(c), row) for c in ("a", "b", "sizes_a", "sizes_b")])
                    at_a, at_b = links(f, lengths_a, lengths_b)
                    pairs, times = np.unique(f.a[at_a].astype(np.int64) * len(pieces_b) + f.b[at_b], return_counts=True)
                    digest = sha256(groups_text(f, texts, len(pieces_a), len(pieces_b))).hexdigest()
                    held.append((doc, len(f.a), len(f.b), len(f.sizes_a) - 1, len(at_a), digest, pairs, times))
                    n += len(pairs)
                if n >= BLOCK_LINKS or len(held) >= 10_000:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return run


def _counted(id_type: pa.DataType):
    """Documents of one block with the counts of their links."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts["at"].to_numpy()
        held = np.zeros((2, int(at.max()) + 1 if len(at) else 0), dtype=np.int64)
        held[0, at], held[1, at] = counts["count"].to_numpy(), counts["best"].to_numpy()
        sums = []
        for steps, times in zip(docs["steps"], docs["times"], strict=True):
            sums.append((held[:, np.cumsum(steps.values.to_numpy())] * times.values.to_numpy()).sum(axis=1) if len(steps) else (0, 0))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table(
            [*[docs[c] for c in names], pa.array([int(s[1]) for s in sums], pa.int64()), pa.array([int(s[0]) for s in sums], pa.int64()), docs["groups_sha256"]],
            names=[*names, "n_best", "count_sum", "groups_sha256"],
        )

    return run


def link_counts(pairs: DataFrame, vocabulary_b: int) -> DataFrame:
    """Documents per pair, and whether no pair of the same A id has more: (pair, count, best) from (pair, docs)."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    top = counts.groupBy(_id_a(vocabulary_b).alias("id_a")).agg(F.max("count").alias("top"))
    # one row per id of A's vocabulary at most
    named = counts.withColumn("id_a", _id_a(vocabulary_b)).join(F.broadcast(top), "id_a")
    return named.select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def _id_a(vocabulary_b: int) -> Column:
    return F.expr(f"pair div {vocabulary_b}")


def alignment_report(
    docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of overlapping tokens, a pair's count the rows that hold
    it linked. Documents are packed in blocks, whose distinct pairs are counted and looked up once
    per block instead of once per document; a pair that most documents hold
    is one row a block. Rows without tokens have zeros and an empty digest.
    """
    id_type = _arrow_type(docs, id_col)
    whole, long = _sources(docs, path_a, path_b, id_col, text_col, part_chars)
    encode, pack, schema = _encoded(path_a, path_b), _blocks(path_a, path_b, id_type), _DOCS.format(docs.schema[id_col].dataType.simpleString())
    packed = whole.mapInArrow(lambda batches: pack(encode(batches)), schema).unionByName(long.mapInArrow(pack, schema))
    packed = stored(packed, "alignment-blocks")
    listed = packed.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "held"))
    listed = listed.select("block", "at", F.col("held.pairs").alias("pair"), F.col("held.docs").alias("docs"))
    counts = link_counts(listed.select("pair", "docs"), len(piece_model(path_b)[1]))
    told = listed.select("block", "at", "pair").join(counts, "pair").select("block", "at", "count", "best")
    rows = packed.where("pairs IS NULL").drop("pairs", "docs")
    out = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    told = told.withColumnRenamed("block", "in_block")
    return rows.groupBy("block").cogroup(told.groupBy("in_block")).applyInArrow(_counted(id_type), out.format(docs.schema[id_col].dataType.simpleString()))
