import numpy as np

from gridwx.llm.common import WORD_HASHES, mix64, rolling


def test_rolling_windows_depend_on_their_words_alone():
    h = np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64)
    for n in (1, 2, 3, 5, 16, 50, 100):
        r = rolling(h, n)
        assert len(r) == 101 - n
        assert all(rolling(h[i : i + n], n)[0] == r[i] for i in range(0, 101 - n, 7))
    assert len(rolling(h, 101)) == 0
    assert rolling(h[:2], 2)[0] != rolling(h[1::-1], 2)[0]
    assert len(set(mix64(np.arange(1000, dtype=np.uint64)).tolist())) == 1000


def test_long_texts_step_by_step():
    raw = b" a bb\tccc \n\n dddd\x0beeeee\x1cf  " * 50
    whole = WORD_HASHES.of_text(raw)
    assert len(whole) == 250
    for step in (1, 7, 100):
        assert (WORD_HASHES.of_text(raw, step) == whole).all()
    assert len(WORD_HASHES.of_text(b"")) == 0
