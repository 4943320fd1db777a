"""Cross-tokenizer alignment by interval coalescing, and the corpus-wide counts of aligned id pairs.

Tasks cut their texts at single spaces, where both vocabularies always cut, and align each distinct chunk of a block once:
all A and B tokens of the block's new chunks are lexsorted by start, the running maximum of their ends is accumulated, and
a group breaks where a start reaches it; overlaps expand within groups. A document is then a list of chunk numbers. The
blocks' distinct id pairs, with the number of their documents, are added up over all blocks by an ordinary aggregation, and
the sums go back to the blocks. Texts that cannot be cut so are one chunk.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwx.llm.bpe import _packed, _spread, _squeeze, _uncut, _unpacked
from gridwx.llm.common import MEMOS, Lists, newest, ragged, remember, stage, stretches

#: Characters of the texts of one block, after which the next one begins.
BLOCK_CHARS = 4 << 20
#: Texts that are cut together.
GROUP = 256
#: Chunks that are encoded together.
LEARNT = 8192
#: Chunks, and their characters, that a worker remembers from block to block.
MEMO_CHUNKS, MEMO_CHARS = 350_000, 24 << 20
#: Bits of a B id in a pair's code; the A id stands above them.
B_BITS = 32

BLOCKS = """block long, doc_ids array<long>, lengths binary, codes binary, groups binary, n_a binary, n_b binary, n_groups binary,
n_links binary, links binary, pairs array<long>, docs array<int>"""
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _byte_of() -> dict[str, int]:
    """Character of byte-level vocabularies -> byte: visible Latin-1 stands for itself, the others from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Chunks of texts and their alignment; a chunk stands for a space and its text, encoded by both vocabularies."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would only wait for each other
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of()
        by_id = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(byte_of.get(c, 0) for c in by_id.get(i, "")) for i in range(max(by_id) + 1)]
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        #: An id as it is written behind each of the separators, by separator and id.
        self.span = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{before}{i}" for before in ("", ",", "|", ";") for i in range(self.span)]
        #: May a text be cut before a space? Not if a piece goes on after one.
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.chars = 0
        self.chunks: dict[str, int] = defaultdict()
        self.chunks.default_factory = self.chunks.__len__
        self.pairs: dict[int, int] = defaultdict()
        self.pairs.default_factory = self.pairs.__len__
        #: By chunk: its groups as text, its numbers of tokens and groups, the numbers of its links' pairs; and does it count?
        self.groups: list[str] = []
        self.sound = np.empty(0, bool)
        self.n_a, self.n_b, self.n_groups = (np.empty(0, np.int64) for _ in range(3))
        self.links = Lists("<u4")

    def cut(self, text: str) -> list[str]:
        return [text] if not self.cuts or _uncut(text) else text.split(" ")

    def numbers(self, chunks: list[str]) -> np.ndarray:
        before = len(self.chunks)
        found = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        if len(self.chunks) > before:
            unseen = newest(self.chunks, before)
            for at in range(0, len(unseen), LEARNT):
                self._learn(unseen[at : at + LEARNT])
        return found

    def _learn(self, chunks: list[str]) -> None:
        self.chars += sum(map(len, chunks))
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        b_ids = self.b.encode(chunks, num_threads=1)
        (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
        raw = [b" " + c.encode() for c in chunks]
        sound = self._sound(raw, a, n_a, b, n_b)
        if not sound.all():
            a_ids, b_ids = ([ids if s else [] for ids, s in zip(found, sound.tolist())] for found in (a_ids, b_ids))
            (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
        chunk = np.concatenate((np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)))
        groups, begins, a_of, b_of = coalesce(self.a_sizes[a], self.b_sizes[b])
        # a chunk's tokens end together, so its groups are its own
        n_groups = np.bincount(chunk[begins], minlength=len(chunks))
        self.groups += self._written(np.concatenate((a, b)), np.arange(len(chunk)) >= len(a), chunk, groups, len(chunks))
        codes = a[a_of] << B_BITS | b[b_of]
        self.links.add(np.fromiter(map(self.pairs.__getitem__, codes.tolist()), "<u4", len(codes)), np.bincount(chunk[a_of], minlength=len(chunks)))
        self.sound = np.concatenate((self.sound, sound))
        self.n_a, self.n_b, self.n_groups = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)))

    def _sound(self, raw: list[bytes], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Of each chunk: do the tokens of both vocabularies give its bytes?"""
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = b"".join(raw)
        sides = ((a, n_a, self.a_sizes, self.a_bytes), (b, n_b, self.b_sizes, self.b_bytes))
        if all((_sums(sizes[ids], n) == lengths).all() and b"".join(map(table.__getitem__, ids.tolist())) == whole for ids, n, sizes, table in sides):
            return np.ones(len(raw), bool)
        found = np.ones(len(raw), bool)
        for ids, n, _, table in sides:
            until = np.cumsum(n)
            for i, (at, end) in enumerate(zip((until - n).tolist(), until.tolist())):
                found[i] &= b"".join(map(table.__getitem__, ids[at:end].tolist())) == raw[i]
        return found

    def _written(self, ids: np.ndarray, side: np.ndarray, chunk: np.ndarray, groups: np.ndarray, n: int) -> list[str]:
        """Each chunk's groups: `a1,a2|b1;a3|b2,b3`."""
        order = np.lexsort((side, groups))
        side, chunk, groups = side[order], chunk[order], groups[order]
        before = np.full(len(order), 1)
        before[1:][side[1:] != side[:-1]] = 2
        before[1:][groups[1:] != groups[:-1]] = 3
        until = np.searchsorted(chunk, np.arange(n + 1))
        before[until[:-1][until[:-1] < until[1:]]] = 0
        parts = list(map(self.names.__getitem__, (before * self.span + ids[order]).tolist()))
        until = until.tolist()
        return ["".join(parts[i:j]) for i, j in zip(until, until[1:])]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and their sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the tokens of one text, cut twice into tokens of these sizes in bytes.

    Returns each token's group (A's tokens, then B's), each group's first token, and the links: the numbers of an A and of
    a B token whose bytes overlap, by A.
    """
    ends = np.concatenate((np.cumsum(a_sizes), np.cumsum(b_sizes)))
    starts = ends - np.concatenate((a_sizes, b_sizes))
    side = np.arange(len(starts)) >= len(a_sizes)
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(breaks) - 1
    n = len(a_sizes)
    first = np.searchsorted(ends[n:], starts[:n], "right")
    overlaps = np.searchsorted(starts[n:], ends[:n], "left") - first
    return groups, order[breaks], np.repeat(np.arange(n), overlaps), stretches(first, overlaps)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
MEMOS["aligners"] = _ALIGNERS.clear


def aligner(a_path: str, b_path: str) -> Aligner:
    remember("aligners")
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _numbered(own: Aligner, texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """Chunk numbers of the texts, one after another, and how many each has; none where a vocabulary changes the text."""
    cut = [own.cut(t) if t else [] for t in texts]
    numbers = own.numbers([c for chunks in cut for c in chunks])
    sizes = [len(chunks) for chunks in cut]
    sound = own.sound[numbers]
    if not sound.all():
        # its bytes may come right only as a whole
        parts = []
        for i, (at, n) in enumerate(zip([0, *accumulate(sizes)], sizes)):
            part = numbers[at : at + n]
            if not sound[at : at + n].all():
                whole = own.numbers([texts[i]])
                part = whole if own.sound[whole[0]] else whole[:0]
            parts.append(part)
        numbers, sizes = np.concatenate(parts), [len(p) for p in parts]
    return numbers, sizes


def _block(own: Aligner, number: int, doc_ids: list, codes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    used, codes = np.unique(codes, return_inverse=True)
    links, n_links = own.links.take(used)
    pairs, links = np.unique(links, return_inverse=True)
    # a document's distinct pairs: its number above the pair's
    until = np.cumsum(n_links) - n_links
    per_code = n_links[codes]
    of_doc = np.repeat(np.repeat(np.arange(len(lengths)), lengths), per_code)
    distinct = np.unique(of_doc << 32 | ragged(links, until[codes], per_code))
    docs = np.bincount(distinct & 0xFFFFFFFF, minlength=len(pairs))
    code_of = np.fromiter(own.pairs, np.int64, len(own.pairs))[pairs]
    packed = [_squeeze(x.astype("<u4")) for x in (own.n_a[used], own.n_b[used], own.n_groups[used], n_links, links)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]),
            pa.array([doc_ids], pa.list_(pa.int64())),
            *(pa.array([_squeeze(x.astype("<u4"))], pa.binary()) for x in (lengths, codes)),
            pa.array([_packed("\n".join([own.groups[i] for i in used.tolist()]).encode())], pa.binary()),
            *(pa.array([x], pa.binary()) for x in packed),
            pa.array([code_of], pa.list_(pa.int64())),
            pa.array([docs.astype(np.int32)], pa.list_(pa.int32())),
        ],
        names="block doc_ids lengths codes groups n_a n_b n_groups n_links links pairs docs".split(),
    )


def align_blocks(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per block of documents, BLOCKS: its documents' chunk numbers, and its distinct chunks' groups and links."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 30
        ids, parts, lengths, size = [], [], [], 0
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
                numbers, sizes = _numbered(own, texts)
                parts.append(numbers)
                lengths += sizes
                at, size = at + len(texts), size + n
                if size >= block_chars:
                    yield _block(own, number, ids, np.concatenate(parts), np.array(lengths))
                    number += 1
                    ids, parts, lengths, size = [], [], [], 0
                    if len(own.chunks) > MEMO_CHUNKS or own.chars > MEMO_CHARS:
                        own.clear()
        if ids:
            yield _block(own, number, ids, np.concatenate(parts), np.array(lengths))
        if len(own.chunks) > MEMO_CHUNKS or own.chars > MEMO_CHARS:
            own.clear()

    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text").mapInArrow(align, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked) and best (no pair of a has more), a row per pair of the corpus."""
    pairs = blocks.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy("pairs").agg(F.sum("docs").alias("n"))
    # at most as many rows as B has pieces meet for an A id
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pairs", B_BITS)))
    counted = pairs.withColumn("best", F.col("n") == highest)
    return counted.select(F.shiftright("pairs", B_BITS).alias("a"), F.col("pairs").bitwiseAND((1 << B_BITS) - 1).alias("b"), "pairs", "n", "best")


def align_documents(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """ALIGNED, a row per row of docs: a space and the text by both vocabularies, and how their tokens meet.

    `groups` holds the ids between byte offsets where tokens of both end, `a1,a2|b1;a3|b2,b3`. Links are all overlapping
    A-B pairs; n_best counts those whose pair is in as many documents as any pair of their A id, count_sum adds up the
    documents of each link's pair. Documents are counted by row, so repeated rows and doc_ids count each. Null and empty
    texts, and texts that a vocabulary changes (U+2581), have zeros and empty groups, and count for no pair; a null doc_id
    stays null; an empty table gives no rows; other columns are not read. One block of texts is in memory at a time.
    """
    blocks = stage(align_blocks(docs, a_path, b_path, block_chars), "aligned")
    places = blocks.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pairs"))
    counts = places.join(pair_counts(blocks).select("pairs", "n", "best"), "pairs").select("of_block", "place", "n", "best")

    def finish(block: pa.Table, counts: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        place = counts.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        lengths, codes, n_links, links = (_spread(row[c].as_py()).astype(np.int64) for c in ("lengths", "codes", "n_links", "links"))
        per_chunk = [_spread(row[c].as_py()).astype(np.int64) for c in ("n_a", "n_b", "n_groups")]
        per_chunk += [n_links, _sums(best[links], n_links), _sums(n[links], n_links)]
        groups, until = _unpacked(row["groups"].as_py()).decode().split("\n"), [0, *np.cumsum(lengths).tolist()]
        order = codes.tolist()
        texts = [";".join([groups[i] for i in order[at:end]]) for at, end in zip(until, until[1:])]
        columns = [_sums(x[codes], lengths) for x in per_chunk]
        return pa.table([row["doc_ids"].values, *map(pa.array, columns), pa.array(texts, pa.string())], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return blocks.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(finish, ALIGNED)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of stretches of these sizes."""
    totals = np.concatenate(([0], np.cumsum(values)))
    until = np.cumsum(sizes)
    return totals[until] - totals[until - sizes]
