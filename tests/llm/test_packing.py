import subprocess
import sys

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gridwx.llm import packing
from tests.llm.helpers import hard_rows, table

PATH = P.path("word_bpe_49k.json")


def reference(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("window", [2048, 64])
def test_pieces_cover_every_document_once(spark, window):
    rows = hard_rows() + [(None, "no id")]
    pieces = packing.pack_documents(table(spark, rows), PATH, window).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(bytes(p["ids"]), "<u4").tolist(), p["doc_tokens"]))
        assert p["length"] == len(p["ids"]) // 4
    repeated = {206}
    for i, text in rows:
        ids = reference(text)
        if i in repeated:
            assert sum(len(x[1]) for x in by_doc[i]) == 2 * len(ids)
            continue
        found = sorted(by_doc[i])
        assert [x for s in found for x in s[1]] == ids and all(s[2] == len(ids) for s in found)
        at = 0
        for start, part, _ in found:
            assert start == at
            at += len(part)
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_only_the_last_window_of_a_shard_is_short():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 300, 200).tolist()
    terms = [rng.integers(0, 500, n) for n in tokens]
    totals = [sum(p[2] for p in w) for w in packing.pack_shard(tokens, terms, 128)]
    assert sum(t != 128 for t in totals) <= 1 and sum(totals) == sum(tokens)


def test_neighbours_share_rare_terms():
    terms = [np.array([1, 2, 3, 9]), np.array([5, 6, 7]), np.array([1, 2, 3, 8]), np.array([5, 6, 10]), *[np.array([100 + i, 200 + i]) for i in range(30)]]
    index = packing.Index(terms)
    open_ = np.ones(len(terms), bool)
    open_[0] = False
    assert index.neighbours(0, open_, 5).tolist() == [2]
    open_[2] = False
    assert index.neighbours(0, open_, 5).tolist() == []


def test_empty_table(spark):
    assert packing.pack_documents(table(spark, [(1, "a")]).limit(0), PATH).count() == 0


def test_copies_meet_wherever_they_stand(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 60)) for _ in range(600)]
    docs = spark.createDataFrame([(i, texts[i % 600]) for i in range(1200)], "doc_id long, text string").repartitionByRange(8, "doc_id")
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    windows = {}
    for p in packing.pack_documents(docs, PATH, 512).collect():
        windows.setdefault(p["doc_id"], set()).add(p["sequence_id"])
    assert np.mean([bool(windows[i] & windows[i + 600]) for i in range(600)]) > 0.9


def test_statistics_are_those_of_all_documents():
    terms = [np.array([1, 2]), np.array([1, 9]), np.array([2, 8])]
    df = np.zeros(packing.TERM_SPACE, np.int64)
    df[[1, 2]] = 2, 900
    open_ = np.array([False, True, True])
    assert packing.Index(terms, packing.Statistics(1000, 2.0, df)).neighbours(0, open_, 5).tolist() == [1, 2]
    df[[1, 2]] = 900, 2
    assert packing.Index(terms, packing.Statistics(1000, 2.0, df)).neighbours(0, open_, 5).tolist() == [2, 1]


def test_a_group_of_copies_is_dealt_over_several_routes():
    levels = np.zeros((len(packing.LEVELS), 50_000), np.int64)
    counts = np.zeros((len(packing.LEVELS), 1 << packing.ROUTE_BITS), np.int32)
    counts[:, 0] = 50_000
    _, found = np.unique(packing.routes(levels, np.arange(50_000), counts), return_counts=True)
    assert len(found) == 49 and found.max() < 2 * packing.ROUTE_DOCS


def test_members_of_a_large_group_find_each_other():
    terms = [np.array([1, 1000 + i]) if i % 3 == 0 else np.array([2000 + i]) for i in range(300)]
    open_ = np.ones(300, bool)
    open_[0] = False
    assert packing.Index(terms).neighbours(0, open_, 300).tolist() == list(range(3, 300, 3))


def test_every_term_of_a_seed_counts():
    rng = np.random.default_rng(2)
    terms = [np.unique(rng.integers(0, 120, rng.integers(1, 90))) for _ in range(80)]
    sets, mean = [set(t.tolist()) for t in terms], np.mean([len(t) for t in terms])
    df = {t: sum(t in s for s in sets) for t in range(120)}

    def score(seed, d):
        norm = packing.K1 * (1 - packing.B + packing.B * len(sets[d]) / mean)
        return sum(np.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) * (packing.K1 + 1) / (1 + norm) for t in sets[seed] & sets[d])

    index = packing.Index(terms)
    for seed in range(80):
        expected = np.array([score(seed, d) for d in range(80)])
        expected[seed] = 0
        open_ = np.arange(80) != seed
        found = index.neighbours(seed, open_, 80)
        assert set(found.tolist()) == set(np.flatnonzero(expected).tolist())
        assert np.allclose(expected[found], np.sort(expected[found])[::-1], atol=1e-4)


def test_texts_of_added_tokens_are_the_librarys_ids():
    texts = ["hello <|endoftext|> x<|startoftext|>y", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext |> é<|endoftext|>", "日本<|startoftext|>日本 <|<|endoftext|>|>", "plain text"]
    library = Tokenizer.from_file(PATH)
    ids, _, sizes = packing.WordTokenizer(PATH).encode(texts)
    for text, one in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert one.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert len(library.encode(texts[0], add_special_tokens=False).ids) == 5


def test_ids_are_the_librarys(monkeypatch):
    """Random texts, long ones in slices, and a worker that forgets its words now and then."""
    monkeypatch.setattr(packing, "SLICE", 300)
    monkeypatch.setattr(packing, "MEMO_CHUNKS", 400)
    monkeypatch.setattr(packing, "MEMO_WORDS", 150)
    rng = np.random.default_rng(8)
    letters = list("aAbBeEéÉßıİſK²³¹½_ªº÷'’.,;-–—…0123456789 \t\n\r\x0b\x1c\x1e\x85\xa0\u2028\u3000\u0301日本🙂<|>'s't're") + ["<|endoftext|>", " they're ", "'LL"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(600)]
    texts += [" ".join(f"word{x}" for x in rng.integers(0, 900, 2000)), "", " \n ", "x" * 5000]
    library, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    for at in range(0, len(texts), 40):
        ids, stops, sizes = words.encode(texts[at : at + 40])
        for text, one in zip(texts[at : at + 40], np.split(ids, np.cumsum(sizes)[:-1])):
            assert one.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_a_worker_keeps_the_words_that_come_again(monkeypatch):
    """A full memo forgets chunks and words that came once; the common ones are encoded once."""
    monkeypatch.setattr(packing, "MEMO_CHUNKS", 300)
    monkeypatch.setattr(packing, "MEMO_WORDS", 300)
    words, learned = packing.WordTokenizer(PATH), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda chunks: (learned.extend(chunks), learn(chunks)))
    letters = "abcdefghij"
    for k in range(20):
        rare = ["rare" + "".join(letters[int(c)] for c in str(k * 1000 + i)) for i in range(90)]
        text = " ".join(["the", "a", "of"] * 9 + rare)
        ids, _, _ = words.encode([text])
        assert ids.tolist() == reference(text)
    assert [learned.count(w) for w in ("the", "a", "of")] == [1, 1, 1]
    assert len(words.chunks) <= 400 and len(words.words) <= 400


def test_few_strings_are_looked_up_in_python(monkeypatch):
    """What a worker knows is found in Arrow: only new chunks become Python strings."""
    import pyarrow as pa

    words, learned = packing.WordTokenizer(PATH), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda chunks: (learned.extend(chunks), learn(chunks)))
    texts = ["the cat, the dog.", None, "", " a  dog.\n", "Straße ½x İ don't"]
    for _ in range(2):
        ids, _, sizes = words.encode(pa.array(["left out", *texts, "left out"]).slice(1, len(texts)))
        for text, one in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert one.tolist() == reference(text)
    assert sorted(learned) == sorted({"", "the", "cat,", "dog.", "a", "Straße", "½x", "İ", "don't"})
    assert len(words.encode(pa.array([], pa.string()))[2]) == 0


def test_a_worker_forgets_long_chunks(monkeypatch):
    """Chunks that never come again are not held beyond MEMO_BYTES, however few they are."""
    monkeypatch.setattr(packing, "MEMO_BYTES", 20_000)
    words = packing.WordTokenizer(PATH)
    for k in range(12):
        text = f"the {'ab' * 1500}{k} {'日' * 900}{k}"
        assert words.encode([text])[0].tolist() == reference(text)
        assert words.chunks.strings.nbytes <= 20_000 and words.words.strings.nbytes <= 20_000 and packing._END in words.chunks.strings.to_pylist()


def test_short_texts_of_many_batches_are_tokenized_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "TOGETHER", 1000)
    texts = ["x" * n for n in (5, 0, 400, 2500, 3, 1200, 900, 50, 50, 50, 50)] + [None] * 200
    whole = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for step in (1, 4, 50, 1000):
        found = list(packing.by_bytes(whole.slice(i, step) for i in range(0, len(texts), step)))
        assert pa.Table.from_batches(found).equals(pa.Table.from_batches([whole]).combine_chunks())
        sizes = [[len(t or "") + 8 for t in g.column(1).to_pylist()] for g in found]
        assert all(sum(x) >= 1000 for x in sizes[:-1]) and all(sum(x[:-1]) < 1000 for x in sizes)
    assert list(packing.by_bytes(iter([]))) == [] and list(packing.by_bytes(iter([whole.slice(0, 0)]))) == []


def test_easy_chunks_have_the_borders_of_all():
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    easy = [c for c, e in zip(letters, pc.match_substring_regex(pa.array(letters), packing._EASY).to_pylist()) if e]
    assert len(easy) > 250 and all(packing._SIMPLE.fullmatch(c) and not re.search(r"\s", c) for c in easy)
    rng = np.random.default_rng(6)
    chunks = [*easy, "", *["".join(rng.choice(easy, n)) for n in rng.integers(0, 9, 4000)], *["".join(rng.choice(list("aÀ1_.É"), n)) for n in rng.integers(0, 9, 2000)], ""]
    whole = pa.array(chunks)
    for part in (whole, whole.slice(300, 500), whole.slice(len(chunks) - 1)):
        words, counts = packing.easy_words(part)
        found = [packing._BORDERS.findall(c.lower()) for c in part.to_pylist()]
        assert words.to_pylist() == [w for x in found for w in x] and counts.tolist() == [len(x) for x in found]


def test_bytes_stand_as_the_byte_level_characters():
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    text = "".join(chr(c) for c in range(0x21, 0x3000) if c != 0x7F) + "日本🙂"
    assert packing.byte_level(text) == level.pre_tokenize_str(text)[0][0] and packing.byte_level("") == ""


def test_terms_are_the_hashes_of_chunks():
    rng = np.random.default_rng(7)
    docs = [[rng.integers(0, 49_000, rng.integers(1, 5)) for _ in range(n)] for n in (3, 0, 1, 50, 0)]
    chunks = [c for d in docs for c in [*d, np.array([1])]]
    ids, stops = np.concatenate(chunks).astype("<u2"), np.concatenate([np.arange(len(c)) == len(c) - 1 for c in chunks]).astype(np.uint8)
    mixed = [int(x) for x in packing.mix64(np.arange(1, (1 << 16) + 1))]

    def term(chunk):
        total = (sum(mixed[i] for i in chunk.tolist()) + 2 * mixed[chunk[0]]) % 2**64
        return int(packing.mix64(np.array([total], np.uint64))[0]) >> (64 - packing.TERM_BITS)

    doc, found = packing.chunk_terms(ids, stops, np.array([sum(map(len, d)) + 1 for d in docs]))
    assert doc.tolist() == [i for i, d in enumerate(docs) for _ in d] and found.tolist() == [term(c) for d in docs for c in d]


def test_white_space_between_chunks_is_pythons():
    parts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in packing._SEPARATORS]
    own, at, counts = packing.distinct_chunks(parts)
    assert counts.tolist() == [len(x.split()) for x in parts] and [own[i] for i in at.tolist()] == [w for x in parts for w in x.split()]
    own, at, counts = packing.distinct_chunks(["a\x1cb c", " x\n", ""])
    assert counts.sum() == len(at) and [own[i] for i in at.tolist() if own[i]] == ["a\x1cb", "c", "x"]


def test_an_index_of_open_documents_scores_alike():
    rng = np.random.default_rng(4)
    terms = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(90)]
    whole, part = packing.Index(terms), packing.Index(terms)
    open_ = np.ones(90, bool)
    for d in rng.permutation(90)[:70].tolist():
        open_[d] = False
        if d % 3 == 0:
            part.keep(open_)
        assert part.neighbours(d, open_, 12).tolist() == whole.neighbours(d, open_, 12).tolist()


_LEFT = """
import os
import numpy as np
from gridwx.llm import packing
from gridwx.llm.common import remember

def megabytes():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

packing.tokenizer("PATH")
before = megabytes()
words = np.random.default_rng(0).integers(0, 26**4, (12, 80000))
spelled = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(4))
for row in words.tolist():
    packing.tokenizer("PATH").encode([" ".join(map(spelled, row))] * 8)
held = megabytes()
remember("shards")
print(before, held, megabytes())
"""


def test_a_worker_gives_back_what_tokenizing_took():
    out = subprocess.run([sys.executable, "-c", _LEFT.replace("PATH", PATH)], capture_output=True, text=True, check=True).stdout
    before, held, after = map(int, out.split())
    assert held > before + 80 and after < before + 40
