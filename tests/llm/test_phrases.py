"""Collocations: every figure against a plain count, whatever the blocks and shards, and hard rows."""

import random
import re
from collections import Counter

import pytest

from gridwx.llm import phrases

SCHEMA = "doc_id long, lang string, text string, word string, a string, n string, id string, block string, rank string"


def brute(rows, support=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {}
    candidates = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    for (lang, words), a in candidates.items():
        longer = [b for (other, w), b in candidates.items() if other == lang and len(w) > len(words) and words in (w[:2], w[1:])]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
    )


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i, lang, text, *"??????") for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs=60, words=40, vocabulary=25):
    rng = random.Random(seed)
    pick = lambda: rng.choice([f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}", "The", "ÉTÉ", "été", "a-b", "x's", "日本", "\x1c", " "])
    ends = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "? ", " ; "]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(pick() + rng.choice(ends) for _ in range(words))) for _ in range(docs)]


HARD = [("en", None), ("en", ""), (None, " \t\n"), ("en", "."), ("en", "one"), ("xx", "rare pair here")]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 100}, {"shards": 1}, {"shards": 12, "block_bytes": 500}, {"top": 3}, {"support": 4}])
def test_equals_plain_count(spark, options):
    rows = corpus(1) + HARD + corpus(2)[:5] * 2
    want = brute(rows, options.get("support", 10), options.get("top", 2000))
    assert len(want) > (5 if "top" in options else 20) and mined(spark, rows, **options) == want


def test_repeats_overlap_and_longer_phrases_contain(spark):
    rows = [("en", "go go go go")] * 10 + [("en", "new york city")] * 12 + [("en", "new york")] * 13 + [("en", "big apple pie")] * 10 + [("en", "big apple")] * 10
    got = mined(spark, rows)
    assert got == brute(rows)
    # "new york": 12 of 25 occurrences are in the longer phrase, "big apple": 10 of 20, "york city": all
    assert {r[2] for r in got} == {"go go go", "new york", "new york city", "big apple pie"}


def test_support_is_met_exactly(spark):
    rows = [("en", "nine nine"), ("en", "ten. ten ten")] * 9 + [("en", "ten ten")]
    assert [r[2:4] for r in mined(spark, rows)] == [("ten ten", 10)]


def test_hot_language_and_one_long_text(spark):
    rng = random.Random(3)
    rows = [("en", " ".join(f"v{rng.randrange(60)}" for _ in range(30_000)))] + corpus(5, docs=20)
    assert mined(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, HARD) == []


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        l, r = rng.randrange(1, 10**14), rng.randrange(1, 10**14)
        rows.append((rng.randrange(1, min(l, r) + 1), l, r))
    rows += [(10**14, 10**14, 10**14), (3, 3, 3)]
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"{phrases._score('a', 'l', 'r')} s").collect()
    assert all(x["s"] == 10**6 * x["a"] ** 2 // (x["l"] * x["r"]) for x in got)


def test_candidates_have_their_share_of_the_support_in_a_shard(spark):
    rows = [(1, 2, -1, s, 3 if s == 0 else 2) for s in range(4)] + [(1, 3, -1, s, 2) for s in range(4)] + [(1, 4, -1, 0, 9), (1, 5, -1, 1, 4), (1, 5, -1, 1, 6)]
    df = spark.createDataFrame(rows, phrases.PHRASES)
    # (1, 2): 9 in all; (1, 3): 8 and nowhere 3; (1, 4): 9; (1, 5): 10 in one shard
    assert [(r["w2"], r["a"]) for r in phrases.son(df).collect()] == [(5, 10)]
    assert sorted((r["w2"], r["a"]) for r in phrases.son(df, support=9, shards=4).collect()) == [(2, 9), (4, 9), (5, 10)]
