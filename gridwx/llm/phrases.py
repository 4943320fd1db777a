"""Phrase collocation mining by SON partitioning.

Tasks cut their texts into pieces and words and keep blocks of one language as word numbers. Words are counted over all
blocks, and those below the support are struck out, as no frequent phrase holds one. The blocks are dealt to a fixed number
of shards. Each shard is mined completely: all its phrases are counted by an aggregation, so that no shard has to fit in
one task, and those with the support divided by the number of shards are locally frequent. A phrase that has the support
in the whole corpus is locally frequent in one shard at least, so the union of the shards' findings misses none. The
candidates of that union are then counted exactly over all shards. Parts, scores and containment follow by joins of what
was found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwx.llm.bpe import _spread, _squeeze
from gridwx.llm.common import partitions, stage

#: Bytes of the texts of one block, after which the next one begins.
BLOCK_BYTES = 16 << 20
#: Bytes of texts that are cut together.
GROUP_BYTES = 1 << 20
#: Rows that are handed on to the JVM at a time.
OUT_ROWS = 1 << 16
#: Shards of the corpus. With four, a phrase of support 10 must occur three times in one of them.
SHARDS = 4
SUPPORT = 10
#: A phrase is dropped if a longer one that holds it has so many hundredths of its occurrences.
CONTAINED = 50
TOP = 2000
NO_LANG = "und"

# What ends a piece, what ends a word, and the byte, unused in UTF-8, that stands for a piece's end.
_PIECE_ENDS, _WORD_ENDS, _BORDER = b".,;:!?\n\x0b\x0c\r", b" \t", b"\xff"
_FOLD = bytes(0xFF if b in _PIECE_ENDS else 0x20 if b in _WORD_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))

BLOCKS = "block long, shard int, lang string, words array<binary>, counts array<long>, n long, codes binary"
PHRASES = "w1 long, w2 long, w3 long, shard int, n long"


class Words:
    """The texts of one language in one block: distinct words by number from 1, and the texts as numbers; 0 ends a piece."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_BORDER]
        self.parts: list[np.ndarray] = []
        self.texts: list[bytes] = []

    def cut(self) -> None:
        found = _BORDER.join(self.texts).translate(_FOLD).replace(_BORDER, b" " + _BORDER + b" ").split() + [_BORDER]
        self.parts.append(np.fromiter(map(self.number.__getitem__, found), "<u4", len(found)))
        self.texts = []


def cut_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shards: int = SHARDS) -> DataFrame:
    """BLOCKS: a row per block and language; words and counts of its distinct words, n of all, codes of its texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made, size, waiting = 0, 0, 0
        langs: dict[str, Words] = defaultdict(Words)

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, own in langs.items():
                own.cut()
                codes = np.concatenate(own.parts)
                counts = np.bincount(codes, minlength=len(own.number))[1:]
                words = list(own.number)[1:]
                columns = [pa.array([(task << 30) + made]), pa.array([(task + made) % shards], pa.int32()), pa.array([lang])]
                columns += [pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([int(counts.sum())])]
                made += 1
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_squeeze(codes)], pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                raw = text.as_buffer().to_pybytes()
                langs[NO_LANG if lang is None else lang].texts.append(raw)
                size, waiting = size + len(raw), waiting + len(raw)
                if waiting >= GROUP_BYTES:
                    for own in langs.values():
                        own.cut()
                    waiting = 0
                if size >= block_bytes:
                    yield from rows()
                    langs.clear()
                    size = waiting = 0
        yield from rows()

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("binary")).mapInArrow(cut, BLOCKS).where("n > 0")


def frequent_words(blocks: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, word (binary), f (occurrences), id: the words that have the support, numbered over all languages."""
    counted = blocks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), "counts")))
    counted = counted.groupBy("lang", "word").agg(F.sum("counts").alias("f")).where(F.col("f") >= support)
    # the numbers must not change when a task runs again, so they are written; then made gapless, as small ones shuffle well
    rows = stage(counted.withColumn("k", F.monotonically_increasing_id()), "frequent-words")
    task = F.shiftright("k", 33)
    sizes = rows.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("size"))
    first = F.coalesce(F.sum("size").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("task", first.alias("first"))), task == F.col("task"))
    return stage(rows.select("lang", "word", "f", (F.col("first") + F.col("k").bitwiseAND((1 << 33) - 1)).alias("id")), "numbered-words")


def block_phrases(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """PHRASES: each block's phrases of two (w3 -1) and three frequent words, by their ids, and how often they occur."""
    places = blocks.select(F.col("block").alias("of_block"), "lang", F.posexplode("words").alias("place", "word"))
    places = places.join(words.select("lang", "word", "id"), ["lang", "word"]).select("of_block", "place", "id")

    def phrases(block: pa.Table, places: pa.Table) -> pa.Table:
        if not block.num_rows or not places.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())], names=["w1", "w2", "w3", "shard", "n"])
        codes = _spread(block.column("codes")[0].as_py())
        ids = places.column("id").to_numpy()
        rank = np.full(int(codes.max()) + 2, -1, np.int64)
        rank[places.column("place").to_numpy() + 1] = np.arange(len(ids))
        words = rank[codes]
        in_pair = (words[:-1] >= 0) & (words[1:] >= 0)
        at = np.flatnonzero(in_pair)
        pairs, pair_of, n2 = np.unique(words[at] * len(ids) + words[at + 1], return_inverse=True, return_counts=True)
        in_triple = np.flatnonzero(np.diff(at) == 1)
        triples, n3 = np.unique(pair_of[in_triple] * len(ids) + words[at[in_triple] + 2], return_counts=True)
        first = pairs[triples // len(ids)]
        w1 = ids[np.concatenate((pairs // len(ids), first // len(ids)))]
        w2 = ids[np.concatenate((pairs % len(ids), first % len(ids)))]
        w3 = np.concatenate((np.full(len(pairs), -1), ids[triples % len(ids)]))
        shard = np.full(len(w1), block.column("shard")[0].as_py(), np.int32)
        found = pa.table([w1, w2, w3, shard, np.concatenate((n2, n3))], names=["w1", "w2", "w3", "shard", "n"])
        return pa.Table.from_batches(found.to_batches(max_chunksize=OUT_ROWS), found.schema)

    return blocks.select("block", "shard", "codes").groupBy("block").cogroup(places.groupBy("of_block")).applyInArrow(phrases, PHRASES)


def son(phrases: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """w1, w2, w3, a: the phrases that have the support, from their counts by block."""
    phrase = ["w1", "w2", "w3"]
    # dealt by phrase, its counts by shard and its count over all shards come out of one shuffle
    mined = phrases.repartition(*phrase).groupBy(*phrase, "shard").agg(F.sum("n").alias("n"))
    local = -(-support // shards)
    candidate = F.max(F.col("n") >= local).alias("candidate")
    return mined.groupBy(*phrase).agg(candidate, F.sum("n").alias("a")).where(F.col("candidate") & (F.col("a") >= support)).drop("candidate")


def _score(a: str, left: str, right: str) -> str:
    """floor(1000000 a a / (l r)) in whole decimals: exact for counts below 10^15."""
    a, left, right = (f"CAST({x} AS DECIMAL(16, 0))" for x in (a, left, right))
    return f"(CAST(1000000 AS DECIMAL(7, 0)) * ({a} * {a})) div ({left} * {right})"


def collocations(docs: DataFrame, top: int = TOP, support: int = SUPPORT, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two or three words.

    a, l and r are the occurrences of the phrase and of its parts at the cut with the lowest score (of equal ones the
    first), n those of all words. A phrase that stands in a longer one with half of its occurrences or more is left out.
    Order: score and a descending, then the phrase by its bytes. Every row of docs counts, repeated ones each time; a null
    text has no words, a null lang is `und`; docs without frequent phrases, or empty, give no rows; columns but lang and
    text are not read. A block of texts, and one text, must fit in a task.
    """
    blocks = stage(cut_blocks(docs, block_bytes, shards), "phrase-blocks")
    words = frequent_words(blocks, support)
    found = stage(son(block_phrases(blocks, words), support, shards), "phrases")
    pairs = found.where("w3 < 0").select("w1", "w2", "a")
    triples = found.where("w3 >= 0")

    def word(k: int) -> DataFrame:
        columns = [F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}")]
        return words.select(*columns, *(["lang"] if k == 1 else []))

    def pair(first: int) -> DataFrame:
        return pairs.toDF(f"w{first}", f"w{first + 1}", f"f{first}{first + 1}")

    held = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    twos = pairs.join(held, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {CONTAINED} * a")
    twos = twos.join(word(1), "w1").join(word(2), "w2")
    twos = twos.selectExpr("lang", "concat_ws(' ', CAST(word1 AS STRING), CAST(word2 AS STRING)) phrase", "a", "f1 l", "f2 r", f"{_score('a', 'f1', 'f2')} score")
    threes = triples.join(pair(1), ["w1", "w2"]).join(pair(2), ["w2", "w3"])
    for k in (1, 2, 3):
        threes = threes.join(word(k), f"w{k}")
    threes = threes.selectExpr("*", f"{_score('a', 'f1', 'f23')} s1", f"{_score('a', 'f12', 'f3')} s2", "concat_ws(' ', CAST(word1 AS STRING), CAST(word2 AS STRING), CAST(word3 AS STRING)) phrase")
    threes = threes.selectExpr("lang", "phrase", "a", "IF(s1 <= s2, f1, f12) l", "IF(s1 <= s2, f23, f3) r", "least(s1, s2) score")
    return _best(twos.union(threes), top).join(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "lang")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language, with their rank: first of each of many parts of a language, then of what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(scored.sparkSession)))
    ranked = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top).drop("part")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)
