import base64

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from gridwx.llm import bpe
from tests.llm.helpers import hard_rows, table

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_ids_and_round_trip(spark):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = hard_rows() + [
        (300, "a\x1cb \x1dc it's  we'll\t\tx \n\n y\n"), (301, "\x00zero \x00\x00 byte\x00"), (302, "  lead and trail  "), (303, "n1 22 333.44 !!! ?! line　wide"),
        (304, "tab\there new\nline\r\nend"), (None, "no id"),
    ]
    for chars in (bpe.BLOCK_CHARS, 300):
        found = bpe.encode_documents(table(spark, rows), PATH, P.PATTERN, chars).collect()
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in rows)
        texts = dict(rows)
        for r in found:
            text = texts[r["doc_id"]] or ""
            assert r["ids"] == own.encode_ordinary(text)
            assert bytes(r["decoded"]).decode() == text
    decoded = bpe.decode_documents(spark.createDataFrame([(1, own.encode_ordinary("héllo")), (2, []), (3, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert [r["decoded"] and bytes(r["decoded"]).decode() for r in sorted(decoded)] == ["héllo", bytearray(b""), None]


def test_empty_table(spark):
    assert bpe.encode_documents(table(spark, [(1, "a")]).limit(0), PATH, P.PATTERN).count() == 0


def test_blocks_of_random_texts_hold_their_pre_tokens():
    rng = np.random.default_rng(3)
    letters = list("aAeé's'll0123 .,!?\t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u3000\x00日本🙂") + [" ", " ", " ", "it's", " we'll", "word"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(900)]
    texts += [" ".join(rng.choice(["one", "two.", "(three)", "it's", "4th"], 40)) for _ in range(100)]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    plain = bpe.pre_tokens(P.PATTERN)
    import regex

    bordered = regex.compile("\x00|" + plain.pattern.replace("[^" + bpe._WHITE + r"\p{L}\p{N}]", "[^" + bpe._WHITE + r"\x00\p{L}\p{N}]"))
    block = bpe.Block(plain.findall, bordered.findall, bpe.Exact(bpe.exact_patterns(P.PATTERN)))
    for at in range(0, len(texts), 50):
        codes, sizes = block.add(texts[at : at + 50])
        words = list(block.words)
        for text, one in zip(texts[at : at + 50], np.split(codes, np.cumsum(sizes)[:-1])):
            assert [b for c in one.tolist() for b in words[c].encode()] == own.encode_ordinary(text)
            assert [words[c] for c in one.tolist()] == plain.findall(text)


def test_rows_in_another_order_fail_the_job(spark, tmp_path):
    seen = str(tmp_path)

    def shuffled(batches):
        import os
        import uuid

        again = len(os.listdir(seen)) > 0
        open(f"{seen}/{uuid.uuid4().hex}", "w").close()
        for batch in batches:
            yield batch.take(pa.array(range(batch.num_rows - 1, -1, -1))) if again else batch

    docs = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(20)], "doc_id long, text string").coalesce(1).mapInArrow(shuffled, "doc_id long, text string")
    with pytest.raises(Exception, match="another order"):
        bpe.encode_documents(docs, PATH, P.PATTERN).collect()


def test_every_code_point_before_a_contraction():
    """Letters and numbers are those of the encoding library, whatever the age of the pattern library's tables."""
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact, encode = bpe.Exact(bpe.exact_patterns(P.PATTERN)), bpe.encoder(PATH).encode
    plain = bpe.pre_tokens(P.PATTERN)
    points = [*range(0x20, 0xD800), *range(0xE000, 0x110000)]
    disputed = 0
    for at in range(0, len(points), 50_000):
        for tail in ("'s ", "1a'll "):
            words = [chr(c) + tail for c in points[at : at + 50_000]]
            need = [exact.needed(w) for w in words]
            disputed += sum(need)
            for found, wanted in ((exact.find, True), (plain.findall, False)):
                text = "".join(w for w, n in zip(words, need) if n == wanted)
                assert [i for word in found(text) for i in encode(word)] == own.encode_ordinary(text)
    assert disputed > 0


def test_disputed_code_points_in_texts(spark):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["\ua7d2's", "a \u0558'll go \u088f1", "\U00010940\U00019050 x", "caf\u00e9 \u00bd's", "plain"]
    found = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(table(spark, list(enumerate(texts))), PATH, P.PATTERN).collect()}
    assert found == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}
