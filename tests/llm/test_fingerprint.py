import collections
import math

import numpy as np

from gridwx.llm import fingerprint as fp
from tests.llm.helpers import hard_rows, table


def test_entropies_equal_brute_force():
    data = np.frombuffer(b"".join((t or "").encode() for _, t in hard_rows())[:5000], np.uint8)
    found = fp.entropies(data)
    for i in range(0, len(found), 37):
        counts = collections.Counter(data[i : i + 64].tobytes())
        h = -sum(c / 64 * math.log2(c / 64) for c in counts.values())
        assert abs(found[i] - 1000 * h / 6) <= 1


def test_long_texts_are_digested_alike():
    text = " ".join(t or "" for _, t in hard_rows()).encode()
    whole = fp.digests([text])[0]
    assert fp.long_digest(text, 3000) == whole == fp.digests([b"", text, b"x"])[1]
    assert fp.from_text(fp.to_text(whole)) == whole


def test_edits_equal_brute_force(spark):
    rows = [r for r in hard_rows() if r[0] != 206]
    found = {r["doc_id"]: r for r in fp.edits(table(spark, rows)).collect()}
    order = sorted(rows)
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = (fp.digests([t.encode()])[0] for t in (text, edited, following))
        r = found[i]
        assert (r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), edited, fp.to_text(a), fp.to_text(b))
        assert abs(r["near_edited"] - fp.likeness(a, b)) < 1e-12 and abs(r["near_next"] - fp.likeness(a, c)) < 1e-12


def test_likeness():
    texts = [t.encode() for _, t in hard_rows() if t and len(t) > 600]
    same = [fp.likeness(d, d) for d in fp.digests(texts)]
    assert set(same) == {1.0}
    a, b = fp.digests(texts[:2])
    assert fp.likeness(a, b) < 0.2
    assert fp.likeness(fp.digests([b""])[0], fp.digests([b""])[0]) == 1.0


def test_edges(spark):
    assert fp.edits(table(spark, [(1, "a")]).limit(0)).count() == 0
    assert fp.edits(table(spark, [(1, "abcd")])).first()["edited"] == "abab"
    odd = fp.edits(table(spark, [(None, "nn"), (5, "aa"), (5, "bb"), (6, None)])).collect()
    assert len(odd) == 4
    plain = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(table(spark, [(1, "same text"), (2, "same text"), (3, None)])).collect()}
    assert plain[1] == plain[2] != plain[3]


def naive_features(text):
    """The selected windows by the definition: rank by entropy, a vote per run of windows, POPULAR votes."""
    n = len(text) - fp.WINDOW + 1
    ranks = []
    for i in range(n):
        counts = collections.Counter(text[i : i + fp.WINDOW])
        h = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in counts.values())
        e = round(1000 * h / math.log2(fp.WINDOW))
        ranks.append(max(0, 1000 - round(100 * abs(e - fp.EXPECTED) / fp.SPREAD)) if fp.LOWEST <= e <= fp.HIGHEST else 10_000)
    votes = collections.Counter()
    for i in range(n - fp.WINDOW + 1):
        run = ranks[i : i + fp.WINDOW]
        if min(run) < 10_000:
            votes[i + run.index(min(run))] += 1
    return [i for i in sorted(votes) if votes[i] >= fp.POPULAR]


def test_selected_windows_equal_brute_force():
    # dyadic counts have exact entropies, so the ranks of both agree to the last digit
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"etaoin shrdlu"), n)) for n in (0, 10, 63, 64, 126, 127, 200, 900)]
    for text in [*texts, b"".join(texts), b"a" * 400, bytes(range(256)) * 2]:
        found = fp.selected_windows(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist()
        expected = naive_features(text)
        assert len(set(found) ^ set(expected)) <= 0.02 * len(expected)


def test_likeness_equals_brute_force():
    texts = [t.encode() for _, t in hard_rows() if t and 3000 < len(t) < 60_000] or [b"x"]
    texts += [texts[0][: len(texts[0]) // 2] + texts[-1][: len(texts[0]) // 2]]
    found = fp.digests(texts)
    for a in found:
        for b in found:
            filters = [[set(np.flatnonzero(np.unpackbits(np.frombuffer(d[1], np.uint8)[i : i + 256])).tolist()) for i in range(0, len(d[1]), 256)] for d in (a, b)]
            sizes = [[min(fp.FILTER_FEATURES, d[0] - fp.FILTER_FEATURES * i) for i in range(len(f))] for d, f in zip((a, b), filters)]
            order = sorted((0, 1), key=lambda k: (len(filters[k]), (a, b)[k][0]))
            (x, nx), (y, _) = (filters[order[0]], sizes[order[0]]), (filters[order[1]], sizes[order[1]])
            if len(x) > 1:
                x = [f for f, n in zip(x, nx) if n >= fp.WINDOW // 4]
            best = []
            for f in x:
                scores = []
                for g in y:
                    chance = len(f) * len(g) / fp.FILTER_BITS
                    s = (len(f & g) - chance) / max(min(len(f), len(g)) - chance, 1e-9)
                    s = min(1.0, max(0.0, s))
                    scores.append(s if s >= fp.CUTOFF else 0.0)
                best.append(max(scores))
            assert abs(fp.likeness(a, b) - (1.0 if a == b else sum(best) / len(best))) < 1e-5
