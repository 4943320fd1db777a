"""Removal of repeated passages by seed and extend.

Every window of `length` consecutive words keeps the smallest of its k-gram hashes as its anchor (winnowing), so equal
windows have equal anchors. A run is a maximal row of a document's windows with one anchor place; equal runs of a document
are one row with all their places, so a text that repeats itself, or a frequent line, gives few rows. Documents are joined
on anchors that several of them have, the seeds:

* Runs that are equal as a whole match the smallest document that has them.
* Different runs on one anchor are extended from it both ways against the run of the anchor's smallest document, as far as
  the words agree, and each keeps the longest stretch of windows in common, one row. Windows beyond that stretch, which only
  another document can share, are compared among themselves.

So every match is found whatever document it is with, and no two documents of a group are paired. What any document with a
smaller id holds too is removed; adjoining stretches add up to maximal repeats. Hashes of anchor and content have 64 bits
each, so a match rests on 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwx.llm.common import WORD_HASHES, binary_array, flat_values, remember, rolling, stage, stretches

LENGTH = 50
GRAM = 16
#: Another multiplier for the hash of a run's or window's content, independent of the anchor's.
_CONTENT = 0xD6E8FEB86659FD93


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    return WORD_HASHES.of_text(text.encode("utf-8", "surrogatepass") if text else b"")


def window_anchors(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words the place and hash of its smallest k-gram, the last one of equals."""
    grams = rolling(hashes, gram)
    width = length - gram + 1
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # minima over a power of two of places, then over the two that cover a window; equal hashes: the later place
    best = np.arange(len(grams))
    span = 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(grams[b] <= grams[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    best = np.where(grams[b] <= grams[a], b, a)
    return best, grams[best]


def runs(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash and content hash of each run, and its first and last window and anchor place (one column each)."""
    place, anchor = window_anchors(hashes, length, gram)
    if not len(place):
        return anchor, np.empty(0, np.uint64), np.empty((0, 3), np.int32)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    windows = rolling(hashes, length, _CONTENT)
    # a run's words are given by its windows' hashes at both ends and its length, one word apart from each other
    total = np.concatenate(([np.uint64(0)], np.cumsum(windows * np.uint64(_CONTENT) + np.uint64(1), dtype=np.uint64)))
    offset = (place[first] - first).astype(np.uint64)
    content = (total[last + 1] - total[first]) * np.uint64(0x9E3779B97F4A7C15) ^ windows[first] ^ (windows[last] >> np.uint64(7)) ^ (offset << np.uint64(40))
    return anchor[first], content, np.column_stack((first, last, place[first])).astype(np.int32)


def _words_rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text")


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, v (anchor), c (content) of every distinct run of every document, and its places: for each a first and last
    window and an anchor place, 32-bit integers."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("hashes")
        for batch in batches:
            parts = [runs(word_hashes(text.as_py()), length, gram) for text in batch.column(1)]
            doc = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            if not len(doc):
                continue
            v, c, places = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((places[:, 0], c, v, doc))
            doc, v, c = doc[order], v[order], c[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (c[1:] != c[:-1])))
            first = np.flatnonzero(new)
            columns = [batch.column(0).take(pa.array(doc[first])), pa.array(v[first].view(np.int64)), pa.array(c[first].view(np.int64))]
            columns.append(binary_array(places[order].ravel(), 3 * np.diff(first, append=len(doc))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "v", "c", "places"])

    return _words_rows(docs.where("doc_id IS NOT NULL")).mapInArrow(find, "doc_id long, v long, c long, places binary")


def _with_windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """doc_id, v, places, windows (64-bit hash of each window) of the wanted runs (doc_id, runs array of v, places)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, flat, sizes = [], [], [], []
            begin = 0
            for i, (text, found) in enumerate(zip(batch.column(1), batch.column(2))):
                windows = rolling(word_hashes(text.as_py()), length, _CONTENT)
                places, n = flat_values(found.values.field(1), "<i4")
                first = places[3 * (np.cumsum(n // 3) - n // 3)[:, None] + np.arange(2)].astype(np.int64)
                fits = first[:, 1] < len(windows)  # of repeated rows with one id, another text may be shorter
                sizes.append(np.where(fits, first[:, 1] - first[:, 0] + 1, 0)[fits])
                flat.append(windows[stretches(first[fits, 0], sizes[-1])])
                at.append(begin + np.flatnonzero(fits))
                doc.append(np.full(len(sizes[-1]), i))
                begin += len(fits)
            doc, at, flat, sizes = (np.concatenate(x) for x in (doc, at, flat, sizes))
            own = batch.column(2).flatten().take(pa.array(at))
            columns = [batch.column(0).take(pa.array(doc)), own.field(0), own.field(1), binary_array(flat, sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "v", "places", "windows"])

    joined = _words_rows(docs).join(wanted, "doc_id").select("doc_id", "text", "runs")
    return joined.mapInArrow(hashed, "doc_id long, v long, places binary, windows binary")


def _extended(pairs: DataFrame) -> DataFrame:
    """Runs beside the run of the smallest document on their anchor: doc_id, v, w, s, e.

    w is null in a row for the windows s to e that a run has in common with that document; else it is the hash of a window
    (s = e) that lies beyond them. pairs: doc_id, v, places, windows, and the other's owner, owner_places, owner_windows.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            common = []
            columns = [batch.column(0).to_pylist(), batch.column(4).to_pylist(), *(batch.column(i) for i in (2, 3, 5, 6))]
            for i, (doc, owner, places, windows, owner_places, owner_windows) in enumerate(zip(*columns)):
                own = np.frombuffer(places.as_buffer(), "<i4").reshape(-1, 3).astype(np.int64)
                other = np.frombuffer(owner_places.as_buffer(), "<i4", 3)
                x, y = (np.frombuffer(w.as_buffer(), np.int64) for w in (windows, owner_windows))
                if doc == owner and own[0, 0] == other[0] and len(x) == len(y) and (x == y).all():
                    continue
                # windows with the anchor at one place in them; they agree on a stretch around the anchor
                shift = int((other[2] - other[0]) - (own[0, 2] - own[0, 0]))
                lo, hi = max(0, -shift), min(len(x), len(y) - shift)
                same = np.zeros(len(x), bool)
                if lo < hi:
                    same[lo:hi] = x[lo:hi] == y[lo + shift : hi + shift]
                found, rest = np.flatnonzero(same), np.flatnonzero(~same)
                if len(found) and doc > owner:
                    common += [(i, s + found[0], s + found[-1]) for s in own[:, 0].tolist()]
                if len(rest):
                    out[0].append(np.full(len(rest) * len(own), i))
                    out[1].append(np.tile(x[rest], len(own)))
                    out[2].append((own[:, 0, None] + rest).ravel())
            stretch = np.array(common, np.int64).reshape(-1, 3).T
            rows, w, at = (np.concatenate([*x, np.empty(0, np.int64)]) for x in out[:3])
            which = pa.array(np.concatenate((stretch[0], rows)))
            columns = [batch.column(0).take(which), batch.column(1).take(which), pa.concat_arrays([pa.nulls(len(common), pa.int64()), pa.array(w)])]
            columns += [pa.array(np.concatenate((x, at)), pa.int32()) for x in stretch[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "v", "w", "s", "e"])

    return pairs.mapInArrow(extend, "doc_id long, v long, w long, s int, e int")


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and rows of windows that also start in a document with a smaller doc_id: first and last window (s, e), or
    the places of a whole run."""
    found = stage(find_runs(docs, length, gram), "runs")
    # an anchor of one document alone matches nothing
    seeds = found.groupBy("v").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    # written first, so that neither side of the join is bound to its keys and a frequent anchor's rows can be split
    seeds = stage(seeds.where("p < q").select("v", (F.col("c1") < F.col("c2")).alias("varied")), "seeds")
    seeded = stage(found.join(seeds, "v"), "seeded")
    # equal runs: all but the smallest document's match as a whole
    owners = stage(seeded.groupBy("v", "c", "varied").agg(F.min("doc_id").alias("owner")), "owners")
    owned = seeded.join(owners.select("v", "c", "owner"), ["v", "c"])
    whole = owned.where("doc_id > owner").select("doc_id", F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), "places")
    # different runs on one anchor: each, as its smallest document has it, is extended against the anchor's smallest document
    varied = owned.where("varied AND doc_id = owner")
    wanted = varied.groupBy("doc_id").agg(F.collect_list(F.struct("v", "places")).alias("runs"))
    several = stage(_with_windows(docs, wanted, length), "several")
    leaders = several.groupBy("v").agg(F.min(F.struct("doc_id", "places", "windows")).alias("m"))
    leaders = stage(leaders.select("v", F.col("m.doc_id").alias("owner"), F.col("m.places").alias("owner_places"), F.col("m.windows").alias("owner_windows")), "leaders")
    pairs = several.join(leaders, "v").select("doc_id", "v", "places", "windows", "owner", "owner_places", "owner_windows")
    extended = stage(_extended(pairs), "extended")
    beyond = extended.where("w IS NOT NULL")
    first = beyond.groupBy("v", "w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).where("owner < other").select("v", "w", "owner")
    shared = beyond.join(stage(first, "shared-windows"), ["v", "w"]).where("doc_id > owner")
    stretched = extended.where("w IS NULL").select("doc_id", "s", "e").unionByName(shared.select("doc_id", "s", "e"))
    return whole.unionByName(stretched.withColumn("places", F.lit(None).cast("binary")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with three columns more: n_words, n_removed, and kept_text, the words that no repeated window covers, joined by spaces.

    Words are split at ASCII white space. The document with the smallest doc_id keeps a passage. A null or empty text has
    no words; a row with a null doc_id is kept whole; rows that share a doc_id are one document, matched by their union of
    windows; an empty table gives no rows. Columns of docs with these names are replaced.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text"), batch.columns[-1]
            counts, removed, kept = [], [], []
            for text, span in zip(texts, spans):
                found = split_words(text.as_py())
                counts.append(len(found))
                if span.is_valid and len(span.values):
                    mark = np.zeros(len(found) + 1, np.int32)
                    whole = flat_values(span.values.field(2), "<i4")[0].reshape(-1, 3)
                    s, e = (np.concatenate((span.values.field(i).drop_null().to_numpy(), whole[:, i])).astype(np.int64) for i in (0, 1))
                    e += length
                    fits = e <= len(found)
                    np.add.at(mark, s[fits], 1)
                    np.add.at(mark, e[fits], -1)
                    covered = np.cumsum(mark[:-1]) > 0
                    found = [w for w, c in zip(found, covered.tolist()) if not c]
                removed.append(counts[-1] - len(found))
                kept.append(b" ".join(found))
            names = [*batch.schema.names[:-1], "n_words", "n_removed", "kept_text"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    docs = docs.drop("n_words", "n_removed", "kept_text")
    spans = repeated_windows(docs, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "places")).alias("spans"))
    spans = spans.withColumnRenamed("doc_id", "of")
    # the rows travel as one column, so no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    joined = rows.join(spans, rows["id"] == spans["of"], "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long, kept_text string"
    return joined.select("doc.*", F.col("spans").alias("")).mapInArrow(cut, schema)
