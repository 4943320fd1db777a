"""Alignment of two tokenizers: every figure against a plain version, hard texts, and blocks of any size."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridwx.llm import align
from tests.llm.helpers import hard_rows, table

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """Per row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), from the contract's words."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown}
    for x in range(256):
        if x not in shown:
            back[chr(256 + len(back) - len(shown))] = x
    found = []
    for i, text in rows:
        text = text or ""
        want = b" " + text.encode()
        encoded = a.encode(" " + text, add_special_tokens=False) if text else None
        tokens_a = [(t, bytes(back[c] for c in piece)) for t, piece in zip(encoded.ids, encoded.tokens)] if text else []
        tokens_b = []
        for t in b.encode(text) if text else []:
            piece = b.id_to_piece(t)
            tokens_b.append((t, bytes([int(piece[3:5], 16)]) if b.is_byte(t) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in tokens_a) != want or b"".join(x for _, x in tokens_b) != want:
            tokens_a = tokens_b = []
        spans = []
        for tokens in (tokens_a, tokens_b):
            at = 0
            spans.append([])
            for t, raw in tokens:
                spans[-1].append((t, at, at + len(raw)))
                at += len(raw)
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, at = [], [0, 0]
        for end in both:
            parts = []
            for k, side in enumerate(spans):
                first = at[k]
                while at[k] < len(side) and side[at[k]][2] <= end:
                    at[k] += 1
                parts.append(",".join(str(t) for t, _, _ in side[first : at[k]]))
            groups.append("|".join(parts))
        links = []
        k = 0
        for t, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((t, spans[1][j][0]))
                j += 1
        found.append((i, len(tokens_a), len(tokens_b), ";".join(groups), len(both), links))
    count = Counter(p for *_, links in found for p in set(links))
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    return [(i, n, m, g, len(l), sum(count[p] == highest[p[0]] for p in l), sum(count[p] for p in l), text) for i, n, m, text, g, l in found]


def aligned(docs, **sizes):
    return [tuple(r) for r in align.align_documents(docs, A, B, **sizes).collect()]


HARD = [
    (900, "Ünïcödé ½ ﬁ é  wide spaces 日本語 🙂👩‍👩‍👧 \x00 \x1c\x1f end"),
    (901, "a▁b"), (902, "▁"), (903, "a ▁ b c"), (904, " lead"), (905, "trail "), (906, "two  gaps"), (907, "line\nbreak\r\n\ttab \n x"),
    (908, "<|endoftext|> <s> </s> <unk> <0x41> [PAD]"), (909, "it's we'll 'twas don't 's"), (910, "﻿ bom ​ zero"), (911, "x" * 3000),
    (912, " "), (913, "\n"), (914, "naïve café 1234567 3.14 http://a.b/c?d=e&f"), (915, "a　b \u0085 c"), (None, "null id"), (916, "same same same"), (916, "same same same"),
    (917, "\U0001f1e9\U0001f1ea ꟒'s \U00010940"), (918, "قدم हिन्दी ไทย"), (919, "\x0b \x0c"),
]


def test_equals_plain_version(spark):
    rows = [r for r in hard_rows() if r[0] not in (210, 211)] + HARD
    want = sorted(brute(rows), key=repr)
    assert sorted(aligned(table(spark, rows)), key=repr) == want
    assert sorted(aligned(table(spark, rows), block_chars=200), key=repr) == want
    assert any(g.count(";") + 1 < max(n, m) for _, n, m, _, _, _, _, g in want if g), "some group has several tokens"


def test_random_texts(spark):
    rng = random.Random(8)
    parts = [" ", " ", " ", "  ", "\n", "a", "the", "ing", "É", "ß", "日", "🙂", "'s", "1", ".", " ", "▁", "\x1d", "x-y", "Donau"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(1, 25)))) for i in range(1500)]
    assert sorted(aligned(table(spark, rows))) == sorted(brute(rows))


def test_long_texts_and_memory_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(align, "MEMO_CHUNKS", 50)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(4000))) for i in range(6)] + [(10, "y" * 20_000)]
    assert sorted(aligned(table(spark, rows), block_chars=1000)) == sorted(brute(rows))


def test_empty_table_and_only_empty_texts(spark):
    assert aligned(table(spark, []).limit(0)) == []
    assert sorted(aligned(table(spark, [(1, None), (2, ""), (3, "▁")]))) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_pair_counts_are_of_documents(spark):
    rows = [(1, "same same"), (2, "same"), (3, "other")]
    blocks = align.align_blocks(table(spark, rows), A, B)
    counts = {(r["a"], r["b"]): (r["n"], r["best"]) for r in align.pair_counts(blocks).collect()}
    assert sorted(n for n, _ in counts.values()) == [1, 2] and all(best for _, best in counts.values())


@pytest.mark.parametrize("seed", range(5))
def test_coalesce_random_cuts(seed):
    rng = np.random.default_rng(seed)
    n = 60
    cuts = [np.unique(np.append(rng.integers(1, n, 15), n)) for _ in range(2)]
    sizes = [np.diff(c, prepend=0) for c in cuts]
    groups, begins, a_of, b_of = align.coalesce(*sizes)
    both = np.intersect1d(*cuts)
    assert len(begins) == len(both)
    assert groups.tolist() == [int(np.searchsorted(both, e)) for c in cuts for e in c]
    starts = [c - s for c, s in zip(cuts, sizes)]
    want = [(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1])) if starts[0][i] < cuts[1][j] and starts[1][j] < cuts[0][i]]
    assert list(zip(a_of.tolist(), b_of.tolist())) == want
