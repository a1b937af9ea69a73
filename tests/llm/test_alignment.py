"""Token alignment against a plain byte-by-byte version; composition of fragments against the uncut text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from dawnchorus.llm import alignment as al

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, a string, b int, part string, pair long, block string"


def odd_texts():
    rng = random.Random(3)
    words = ["wörter", "and", "x", "  ", "\n", "<s>", "<|endoftext|>", "it's", "12345", "日本語", "🦜", "\tTab", "...", "naïve", "</s>"]
    mixed = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    long = " ".join("".join(rng.choice("abcdeé \n") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    return [None, "", " ", "a", "▁ a piece of the other alphabet", "end ", "\n\n", "nul\x00l", "x" * 900, "no space " + "y" * 700, long, mixed[0], *mixed]


def plain(texts):
    """The libraries' own tokens of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    model_a, model_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    model_a.encode_special_tokens = True
    encode_a = lambda ts: [e.ids for e in model_a.encode_batch(ts, add_special_tokens=False)]
    encode_b = model_b.encode
    pieces_a, pieces_b = al.byte_level(A)[1], al.piece_model(B)[1]
    docs = []
    for t in texts:
        a, b = (encode_a([" " + t])[0], encode_b([t])[0]) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(pieces_a[i] for i in a) != whole or b"".join(pieces_b[i] for i in b) != whole:
            docs.append(None)
            continue
        spans = []
        for ids, pieces in ((a, pieces_a), (b, pieces_b)):
            ends = np.cumsum([len(pieces[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [
            "|".join(",".join(str(i) for _, e, i in side if low < e <= high) for side in spans)
            for low, high in zip([0, *shared[:-1]], shared, strict=True)
        ]
        owner = [[(s, e, i) for s, e, i in side] for side in spans]
        found, k = [], 0
        for s, e, i in owner[0]:
            while owner[1][k][1] <= s:
                k += 1
            j = k
            while j < len(owner[1]) and owner[1][j][0] < e:
                found.append((i, owner[1][j][2]))
                j += 1
        docs.append((len(a), len(b), groups, found))
    held = Counter(p for d in docs if d for p in set(d[3]))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(held[p] == top[p[0]] for p in d[3])
            digest = hashlib.sha256(";".join(d[2]).encode()).hexdigest()
            out.append((d[0], d[1], len(d[2]), len(d[3]), best, sum(held[p] for p in d[3]), digest))
    return out


@pytest.mark.parametrize("part_chars", [1 << 16, 64])
def test_equals_a_plain_version(spark, part_chars):
    texts = odd_texts()
    rows = [(i if i != 7 else None, t, "a", 1, "p", 5, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[12]], SCHEMA).repartition(3)
    got = al.alignment_report(docs, A, B, part_chars=part_chars)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want = [(r[0], *p) for r, p in zip([*rows, rows[12]], plain([*texts, texts[12]]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_aligned_tokens_spell_the_text(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "a", 1, "p", 5, "k") for i, t in enumerate(texts)], SCHEMA)
    pieces = al.byte_level(A)[1], al.piece_model(B)[1]
    for r in al.alignments(docs, A, B, part_chars=100).collect():
        if r["valid"]:
            spelled = [b"".join(p[i] for i in ids) for p, ids in zip(pieces, (r["a"], r["b"]), strict=True)]
            assert spelled == [(" " + texts[r["doc_id"]]).encode()] * 2
            assert sum(r["sizes_a"]) == len(r["a"]) and sum(r["sizes_b"]) == len(r["b"]) and r["sizes_a"][-1] == 0
        else:
            assert not texts[r["doc_id"]] or "▁" in texts[r["doc_id"]]


def test_words_put_together_equal_whole_texts(monkeypatch):
    rng = random.Random(5)
    words = ["plain", "wörter", "it's", "a\nb", "\nline", "end\n", "\t", "▁x", "日本語", "🦜", "nul\x00l", "12,5", "</s>", "...", "\u3000y", "e\u0301"]
    texts = [" " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += ["", " ", " a  b", " a ", "  a", " a \n b", " a\n \n b", *(f" {w}" for w in words)]
    for remembered in (150_000, 5):
        monkeypatch.setattr(al, "_REMEMBERED", remembered)
        memory = al.Words(A, B)
        for low in range(0, len(texts), 7):
            for t, f in zip(texts[low : low + 7], memory.fragments(texts[low : low + 7]), strict=True):
                want = al.whole_fragment(t, t, A, B)
                assert (f is None) == (want is None), t
                if f is not None:
                    assert [getattr(f, c).tolist() for c in ("a", "b", "sizes_a", "sizes_b")] == [
                        getattr(want, c).tolist() for c in ("a", "b", "sizes_a", "sizes_b")
                    ], t


def test_a_word_is_encoded_once(monkeypatch):
    memory, real, seen = al.Words(A, B), al.whole_fragment, []
    monkeypatch.setattr(al, "whole_fragment", lambda a, b, *rest: seen.append(a) or real(a, b, *rest))
    for _ in range(3):
        memory.fragments([" few words come again and again" * 50, " again few"])
    assert len(seen) == 1 and sorted(seen[0].split()) == sorted({"few", "words", "come", "again", "and"})


def test_empty_table(spark):
    assert al.alignment_report(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_composition_is_associative():
    rng = random.Random(11)
    for _ in range(300):
        lengths = np.arange(8)
        a, b = ([rng.randrange(1, 8) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        a, b = (np.array(x + [1] * (max(sum(a), sum(b)) - sum(x)), np.int32) for x in (a, b))
        cuts = [sorted(rng.randrange(len(x) + 1) for _ in range(4)) for x in (a, b)]
        parts = []
        for k in range(5):
            (la, ha), (lb, hb) = (([0, *c, len(x)][k], [0, *c, len(x)][k + 1]) for c, x in zip(cuts, (a, b), strict=True))
            parts.append(al.cut(a[la:ha], b[lb:hb], lengths, lengths, int(a[:la].sum() - b[:lb].sum())))
        order = list(parts)
        while len(order) > 1:  # any bracketing
            k = rng.randrange(len(order) - 1)
            order[k : k + 2] = [al.composed(order[k], order[k + 1], lengths, lengths)]
        want = al.cut(a, b, lengths, lengths)
        for name in ("a", "b", "sizes_a", "sizes_b"):
            assert getattr(order[0], name).tolist() == getattr(want, name).tolist()
