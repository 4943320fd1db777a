import random

from gridwx.llm import substring
from tests.llm.helpers import edited, hard_rows, prose, table


def brute(rows, length):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        covered = [False] * len(words)
        windows = [tuple(words[k : k + length]) for k in range(len(words) - length + 1)]
        for k, w in enumerate(windows):
            if w in first:
                covered[k : k + length] = [True] * length
        for w in windows:
            first.setdefault(w, i)
        out[i] = (len(words), sum(covered), b" ".join(w for w, c in zip(words, covered) if not c).decode())
    return out


def check(spark, rows, length, gram):
    found = substring.remove_repeats(table(spark, rows), length, gram)
    assert {"node", "start", "row"} <= set(found.columns)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()} == brute(rows, length)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [r for r in hard_rows() if r[0] != 206]
    passage, line = prose(rng, 80), " ".join(["same"] * 70)
    for i in range(30):
        parts = [prose(rng, rng.randrange(60)) for _ in range(3)]
        cut = passage.split()[rng.randrange(20) : 60 + rng.randrange(20)]
        parts.insert(rng.randrange(4), " ".join(cut))
        if i % 5 == 0:
            parts.insert(rng.randrange(4), line)
        if i % 3 == 0:
            parts.append(edited(rng, passage, 1))
        rows.append((400 + i, " \n".join(parts)))
    check(spark, rows, 50, 16)
    check(spark, rows, 10, 4)


def test_few_distinct_words(spark):
    rng = random.Random(6)
    check(spark, [(i, prose(rng, 120, 2)) for i in range(25)], 12, 5)


def test_edges(spark):
    assert substring.remove_repeats(table(spark, [(1, "a")]).limit(0)).count() == 0
    text = " ".join(map(str, range(60)))
    rows = {(r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(table(spark, [(None, text), (1, text), (2, text)])).collect()}
    assert rows == {(None, 0), (1, 0), (2, 60)}
