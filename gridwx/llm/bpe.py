"""Byte-level BPE by a global shuffle of distinct words.

Tasks cut their texts into pre-tokens and number the distinct ones of each block of documents; a document is then a list of
word numbers, its pre-tokens by position. The blocks' distinct words are dealt out by a hash of the word, so that each word
is encoded once, by whichever task holds it; the ids go back to the blocks, where they are put in the places of their words.
Decoding looks the ids up in the table of token bytes. A frequent word travels once per block, not once per occurrence.

The texts are read twice, once for the words and once for the positions, as that moves less than keeping either. Both
reads see the same blocks, since a block depends only on its place in the scan of unchanged files; where an input gives its
rows in another order the second time, the blocks' checksums tell and the job fails.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridwx.llm.common import Lists, newest, partitions, ragged

#: Characters of the texts of one block, after which the next one begins.
BLOCK_CHARS = 8 << 20
#: Texts that are cut into pre-tokens together.
GROUP = 256
#: Hash classes of words for each shuffle partition.
CLASSES = 4
#: Divides chunks that are cut together; texts that hold it are cut alone.
_BORDER = "\x00"

# White_Space of Unicode, which the pattern's \s means.
_WHITE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def pre_tokens(pattern: str):
    """Compiled pattern with \\s and \\S spelled out, since libraries disagree on the separators U+001C to U+001F."""
    import regex

    spelled = pattern.replace(r"[^\s", "[^" + _WHITE).replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
    return regex.compile(spelled)


def _every() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache
def library_class(name: str) -> str:
    """The code points of a Unicode class as the encoding library has them: it finds them in a text of all."""
    import tiktoken

    library = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(library.encode_ordinary(_every())).decode()


def _ranges(characters: str) -> str:
    """What stands between the brackets of a pattern's class of these characters, which are in order."""
    points = np.frombuffer(characters.encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    last = np.append(first[1:], len(points)) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[first].tolist(), points[last].tolist()))


@lru_cache
def exact_patterns(pattern: str) -> tuple[str, str]:
    """pre_tokens()'s pattern with the letters and numbers of the encoding library, whose Unicode tables are of another age
    (it is slower), and a pattern that finds the code points for which that makes a difference."""
    import regex

    classes = {name: _ranges(library_class(name)) for name in ("L", "N")}
    spelled = pre_tokens(pattern).pattern.replace(_WHITE + r"\p{L}\p{N}]", _WHITE + classes["L"] + classes["N"] + "]")
    spelled = spelled.replace(r"\p{L}", f"[{classes['L']}]").replace(r"\p{N}", f"[{classes['N']}]")
    disputed = set()
    for name in classes:
        disputed |= set(regex.findall(rf"\p{{{name}}}", _every())) ^ set(library_class(name))
    return spelled, f"[{_ranges(''.join(sorted(disputed)))}]" if disputed else "(?!)"


class Exact:
    """Cuts texts that hold disputed code points."""

    def __init__(self, patterns: tuple[str, str]) -> None:
        self.spelled, self.disputed, self._find = patterns[0], re.compile(patterns[1]), None

    def needed(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")  # a plain copy; the libraries agree on what is below U+0100
        except UnicodeEncodeError:
            return self.disputed.search(text) is not None
        return False

    def find(self, text: str) -> list[str]:
        if self._find is None:
            import regex

            self._find = regex.compile(self.spelled).findall
        return self._find(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class WordEncoder:
    """ids of one pre-token, by the ranks alone."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = read_ranks(path)
        self.ranks = ranks
        self.encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes one after another, and each id's place and length."""
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            by_id[i] = token
        sizes = np.array([len(t) for t in by_id], np.int64)
        return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(sizes) - sizes, sizes


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Block:
    """Numbers the distinct pre-tokens of one block of documents."""

    def __init__(self, find, find_bordered, exact: Exact) -> None:
        self.find, self.find_bordered, self.exact = find, find_bordered, exact
        self.words: dict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        #: Chunks between spaces by number, and the word numbers of each; a text's first chunk has the border before it.
        self.chunks: dict[str, int] = defaultdict()
        self.chunks.default_factory = self.chunks.__len__
        self.chunk_words = Lists("<u4")

    def _codes(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, found), "<u4", len(found))

    def _learn(self, chunks: list[str]) -> None:
        """Word numbers of chunks, all cut in one pass."""
        codes = self._codes(self.find_bordered(_BORDER.join([c[1:] if c.startswith(_BORDER) else " " + c for c in chunks])))
        border = codes == self.words[_BORDER]
        self.chunk_words.add(codes[~border], np.diff(np.concatenate(([-1], np.flatnonzero(border), [len(codes)]))) - 1)

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' word numbers, one text after another, and how many each has.

        A space begins a pre-token unless more white space follows, so a text may be cut before each of its single spaces
        that stand between other characters. Other texts are matched as they are, and those with disputed letters or numbers
        by the exact pattern.
        """
        chunks: list[str] = []
        ends: list[int] = []
        whole: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if self.exact.needed(text):
                whole[i] = self._codes(self.exact.find(text))
            elif _uncut(text):
                whole[i] = self._codes(self.find(text))
            else:
                own = text.split(" ")
                own[0] = _BORDER + own[0]
                chunks += own
            ends.append(len(chunks))
        before = len(self.chunks)
        numbers = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        if unseen := newest(self.chunks, before):
            self._learn(unseen)
        flat, sizes = self.chunk_words.take(numbers)
        until = np.concatenate(([0], np.cumsum(sizes)))[ends]
        sizes = np.diff(until, prepend=0)
        if whole:
            parts = np.split(flat, until[:-1])
            for i, codes in whole.items():
                parts[i], sizes[i] = codes, len(codes)
            flat = np.concatenate(parts)
        return flat, sizes

    def in_classes(self, classes: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words in order of their hash class, where each class begins, and the new number of each old one."""
        raw = [w.encode() for w in self.words]
        of = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % classes
        order = np.argsort(of, kind="stable")
        rank = np.empty(len(raw), "<u4")
        rank[order] = np.arange(len(raw))
        return [raw[i] for i in order.tolist()], np.searchsorted(of[order], np.arange(classes + 1)), rank

    def checksum(self, ids: list, words: list[bytes]) -> int:
        return zlib.crc32(b" ".join(words), zlib.crc32(repr(ids).encode()))


_BESIDE_SPACE = ["  ", *[x for c in "\t\n\x0b\x0c\r" for x in (f" {c}", f"{c} ")], _BORDER]
_WIDE_SPACE = re.compile("[" + _WHITE.replace(r"\t-\r\x20", "") + "]")


def _uncut(text: str) -> bool:
    """Empty, white space at an end or beside a space, or white space beyond ASCII."""
    return not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in _BESIDE_SPACE) or (not text.isascii() and _WIDE_SPACE.search(text) is not None)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, exact: tuple[str, str], block_chars: int) -> Iterator[tuple[int, Block, list, np.ndarray, np.ndarray]]:
    """Number, words, doc_ids, codes and their count in each document of each block."""
    plain = pre_tokens(pattern)
    import regex

    bordered = regex.compile("\x00|" + plain.pattern.replace("[^" + _WHITE + r"\p{L}\p{N}]", "[^" + _WHITE + r"\x00\p{L}\p{N}]"))
    number = TaskContext.get().partitionId() << 30
    finders = plain.findall, bordered.findall, Exact(exact)
    block, ids, parts, size = Block(*finders), [], [], 0

    def done() -> tuple:
        return number, block, ids, *(np.concatenate(x) for x in zip(*parts))

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, GROUP)
            texts, n = [], 0
            for text in part.column(1):
                texts.append(text.as_py() or "")
                n += len(texts[-1])
                if size + n >= block_chars:
                    break
            ids += part.column(0).slice(0, len(texts)).to_pylist()
            parts.append(block.add(texts))
            at, size = at + len(texts), size + n
            if size >= block_chars:
                yield done()
                number += 1
                block, ids, parts, size = Block(*finders), [], [], 0
    if ids:
        yield done()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids array<int> and decoded (binary, the ids' token bytes), a row per row of docs.

    A null or empty text has no ids; null and repeated doc_ids are kept as they are; an empty table gives no rows; other
    columns are not read. Whole texts are held in memory one block at a time. The input is read twice and must give its rows in
    one order, as files do; else the job fails.
    """
    texts = docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text")
    tasks = partitions(docs.sparkSession)
    classes = CLASSES * tasks
    exact = exact_patterns(pattern)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, ids, _, _ in _blocks(batches, pattern, exact, block_chars):
            words, begin, _ = block.in_classes(classes)
            sizes = np.array([len(w) for w in words], "<u4")
            found = [k for k in range(classes) if begin[k] < begin[k + 1]]
            parts = [slice(begin[k], begin[k + 1]) for k in found]
            columns = [pa.array(np.full(len(found), number)), pa.array(np.full(len(found), block.checksum(ids, words))), pa.array(found, pa.int32())]
            columns += [pa.array([_squeeze(sizes[p]) for p in parts], pa.binary()), pa.array([_packed(b"".join(words[p])) for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "sum", "class", "sizes", "words"])

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, ids, codes, lengths in _blocks(batches, pattern, exact, block_chars):
            words, _, rank = block.in_classes(classes)
            packed = [_squeeze(lengths.astype("<u4")), _squeeze(rank[codes] if len(rank) else codes)]
            columns = [pa.array([number], pa.int64()), pa.array([block.checksum(ids, words)], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in packed)], names=["block", "sum", "doc_ids", "lengths", "codes"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of a class once; rows come class by class."""
        one = encoder(ranks_path).encode
        known: dict[bytes, bytes] = {}
        last = None
        for batch in batches:
            sizes, ids = [], []
            for class_, size, raw in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if class_ != last:
                    known, last = {}, class_
                raw, at, found = _unpacked(raw.as_py()), 0, []
                for n in _spread(size.as_py()).tolist():
                    word = raw[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(one(word.decode()), "<u4").tobytes()
                    found.append(got)
                sizes.append(_squeeze(np.array([len(f) // 4 for f in found], "<u4")))
                ids.append(_squeeze(np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["block", "sum", "class", "sizes", "ids"])

    words = texts.mapInArrow(words_of, "block long, sum long, class int, sizes binary, words binary")
    ids = words.repartition(tasks, "class").sortWithinPartitions("class").mapInArrow(encode, "block long, sum long, class int, sizes binary, ids binary")
    codes = texts.mapInArrow(codes_of, "block long, sum long, doc_ids array<long>, lengths binary, codes binary")

    def reassemble(places: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("class")
        if len({*places.column("sum").to_pylist(), *found.column("sum").to_pylist()}) > 1:
            raise RuntimeError("the rows came in another order when they were read again; write the table first")
        none = np.empty(0, "<u4")
        sizes = np.concatenate([none, *(_spread(x.as_py()) for x in found.column("sizes"))]).astype(np.int64)
        flat = np.concatenate([none, *(_spread(x.as_py()) for x in found.column("ids"))])
        starts = np.cumsum(sizes) - sizes
        token, token_starts, token_sizes = encoder(ranks_path).table()
        doc_ids, per_doc, parts, decoded = [], [], [], []
        for row_ids, lengths, packed in zip(*[places.column(c) for c in ("doc_ids", "lengths", "codes")]):
            order, at = _spread(packed.as_py()), 0
            for n in _spread(lengths.as_py()).tolist():
                which = order[at : at + n]
                ids = ragged(flat, starts[which], sizes[which])
                at += n
                parts.append(ids)
                per_doc.append(len(ids))
                decoded.append(ragged(token, token_starts[ids], token_sizes[ids]).tobytes())
            doc_ids += row_ids.as_py()
        offsets = pa.array(np.concatenate(([0], np.cumsum(per_doc))).astype(np.int32))
        values = pa.array(np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, values), "decoded": pa.array(decoded, pa.binary())})

    return codes.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(reassemble, "doc_id long, ids array<int>, decoded binary")


def _packed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _squeeze(values: np.ndarray) -> bytes:
    """Little-endian 32-bit integers by planes of bytes, compressed."""
    return _packed(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 4).T.tobytes())


def _spread(packed: bytes) -> np.ndarray:
    return np.frombuffer(_unpacked(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and decoded (binary) of rows doc_id, ids array<int>: the bytes of the ids' tokens; null ids give null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, starts, sizes = encoder(ranks_path).table()
        for batch in batches:
            rows = [np.array(x.as_py(), np.int64) if x.is_valid else None for x in batch.column(1)]
            found = [None if x is None else ragged(token, starts[x], sizes[x]).tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "decoded"])

    return encoded.selectExpr("CAST(doc_id AS LONG) doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")
