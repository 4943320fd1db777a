"""Lexical retrieval packing: windows of token ids filled with documents that share rare words.

All documents are tokenized once. Document frequencies and the mean length are counted over all of them, and each document
is routed by its strongest shared terms: documents of one route meet in one index shard wherever they stood in the input. A
shard has a bounded size and a BM25 inverted index. The longest unused document seeds a window; the index returns its unused
neighbours, which fill the window greedily, best first. The last neighbour is cut where the window is full, and its rest
stays in the index. Documents longer than a window give whole windows first. Only the last window of a shard can be short.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridwx.llm.common import MEMOS, Lists, binary_array, flat_values, mix64, ragged, release, remember, stage, stretches

WINDOW = 2048
END_ID = 1
#: Ids, and documents, of one index shard.
SHARD_TOKENS = 2 << 20
SHARD_DOCS = 4096
#: Neighbours asked for at a time, and the BM25 parameters.
NEIGHBOURS = 32
K1, B = 1.2, 0.75
#: Terms found in a larger part of a shard's documents are kept as rows over all of them instead of postings.
COMMON = 0.1
#: An index drops its used documents' postings when less than this part of its documents is open.
KEEP = 0.75
TERM_BITS = 20
TERM_SPACE = 1 << TERM_BITS
#: A document's route is the hash of its 1, 2, 4 or 8 strongest shared terms: the first that ROUTE_DOCS documents at most
#: have. Where even the last has more (copies, no shared term), they are dealt over several routes.
LEVELS = (1, 2, 4, 8)
ROUTE_BITS = 18
ROUTE_DOCS = 1024
#: Terms of fewer documents count like terms of so many in a route, so that a word shared by chance does not decide it.
RARE = 16
#: Counts are added up by slices of so many places; the slice TOTALS holds the numbers of documents and of their terms.
SLICE_PLACES = 4096
TOTALS = -1
#: Chunks and words whose ids a worker remembers, and the bytes that either may have; beyond, those that came once are forgotten.
MEMO_CHUNKS = 800_000
MEMO_WORDS = 800_000
MEMO_BYTES = 32 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SPACE = re.compile(r"[ \t\n\r]+")
#: str.split() takes these for white space, the vocabulary does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Chunks (joined by line feeds) whose words the library borders and lower-cases as Python does.
_SIMPLE = re.compile(r"[\n\x21-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027]*")
#: Those of ASCII without apostrophes and Latin letters, which change kind (letter, digit, other) at their word borders.
_EASY = r"\A[\x21-\x26\x28-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17e}]*\z"
_DIGIT = 1
#: The kind of each byte of lower-case easy chunks.
_KINDS = np.array([0 if i >= 0x80 or chr(i).islower() else _DIGIT if chr(i).isdigit() else 2 for i in range(256)], np.uint8)
#: The UTF-8 of the character that stands for each byte in byte-level vocabularies: those beyond ASCII have two bytes.
_NAMED = [i in range(0x21, 0x7F) or i in range(0xA1, 0xAD) or i >= 0xAE for i in range(256)]
_CHARACTERS = [chr(i if i < 0x80 or _NAMED[i] else 256 + _NAMED[:i].count(False)).encode() for i in range(256)]
_FIRST_BYTE, _LAST_BYTE = (np.array([x[i] for x in _CHARACTERS], np.uint8) for i in (0, -1))
#: The vocabulary's word borders in lower-case plain text, and line feeds. The numbers of Latin that are no decimal digits
#: stand by name, as Python counts them as letters.
_BORDERS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|\n|(?:[^\w\s]|_)+")
#: A text is tokenized in slices of about this many characters, cut at white space; texts are tokenized together up to so many
#: bytes, and GROUP documents are dealt to routes at a time.
SLICE = 1 << 20
TOGETHER = 4 << 20
GROUP = 512
#: Chunks whose ids are put in their places at a time.
EXPANDED = 1 << 18
#: Stands for the end of a document among its chunks, which hold no line feed.
_END = "\n"


class Memo:
    """Distinct strings in Arrow, numbered as they come, the ids of each, and how often each was looked up."""

    def __init__(self, first: str, ids: np.ndarray) -> None:
        self.strings = pa.array([first], pa.string())
        self.ids = Lists(ids.dtype.str)
        self.ids.add(ids, np.array([len(ids)], np.int64))
        self.uses = np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.strings)

    def numbers(self, own: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The numbers of distinct strings, and the new ones among them: these have the next numbers, and `ids` waits for theirs."""
        numbers = np.full(len(own), -1)
        # the few are hashed and the many looked up among them, as the hash table is made each time
        place = pc.index_in(self.strings, value_set=own).fill_null(-1).to_numpy()
        had = np.flatnonzero(place >= 0)
        numbers[place[had]] = had
        unseen = numbers < 0
        new = own.filter(pa.array(unseen))
        numbers[unseen] = np.arange(len(self), len(self) + len(new))
        self.strings = pa.concat_arrays([self.strings, new])
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.uses[numbers] += 1
        return numbers, new.to_numpy(zero_copy_only=False).tolist()

    def forget(self, most: int) -> None:
        """With more strings than `most`, or more than MEMO_BYTES of them, keep those that were looked up more than once, or so
        often that half of either holds them, and the first."""
        if len(self) <= most and self.strings.nbytes <= MEMO_BYTES:
            return
        sizes, least = pc.binary_length(self.strings).to_numpy().astype(np.int64), 2
        while np.count_nonzero(self.uses >= least) > most // 2 or sizes[self.uses >= least].sum() > MEMO_BYTES // 2:
            least *= 2
        keep = self.uses >= least
        keep[0] = True
        lists = Lists(self.ids.flat.dtype.str)
        lists.add(*self.ids.take(np.flatnonzero(keep)))
        self.strings, self.ids, self.uses = self.strings.filter(pa.array(keep)), lists, np.ones(np.count_nonzero(keep), np.int64)


class WordTokenizer:
    """Token ids of white-space separated chunks by the tokenizers library, each distinct word encoded once per worker.

    The vocabulary drops white space and never merges across it, so a text's ids are its chunks' ids in order. Texts are split,
    their distinct chunks found and these looked up in Arrow; a chunk's ids are looked up by its number. New chunks of plain
    Latin text are split at the vocabulary's own word borders, and their new words are encoded together: every word ends in one
    end-of-word token, which cuts the ids apart. Any other chunk, and one with the text of an added token, is encoded alone.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        #: The same vocabulary for words that are lower-case, cut apart and in byte_level() already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        added = self.model.get_added_tokens_decoder()
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values())) if added else None
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.ends = np.ones(max([end_id, *vocabulary.values(), *added]) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.kind = id_type(self.ends)
        self.words = Memo("", np.empty(0, self.kind))
        self.chunks = Memo(_END, np.array([end_id], self.kind))

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words, one after another, and how many each has."""
        coded = words.dictionary_encode()
        numbers, unseen = self.words.numbers(coded.dictionary)
        if unseen:
            ids = np.array(self.of_words.encode_batch_fast([byte_level(" ".join(unseen))], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(unseen):
                raise ValueError("the vocabulary does not end each word with one end-of-word token")
            self.words.ids.add(ids, np.diff(cuts, prepend=0))
        return self.words.ids.take(numbers[coded.indices.to_numpy()])

    def _learn(self, chunks: list[str]) -> None:
        strings = pa.array(chunks, pa.string())
        whole = np.ones(len(chunks), bool)
        if self.added and self.added.search("\n".join(chunks)):
            whole = np.array([self.added.search(c) is None for c in chunks])
        easy = whole & pc.match_substring_regex(strings, _EASY).to_numpy(zero_copy_only=False)
        words, counts = easy_words(strings.filter(pa.array(easy)))
        plain, odd, found = [], [], []
        for i in np.flatnonzero(~easy).tolist():
            if whole[i] and _SIMPLE.fullmatch(chunks[i]) and unicodedata.is_normalized("NFC", chunks[i]):
                plain.append(i)
                found.append(_BORDERS.findall(chunks[i].lower()))
            else:
                odd.append(i)
        words = pa.concat_arrays([words, pa.array(chain.from_iterable(found), pa.string())])
        ids, of_word = self._word_ids(words)
        until = np.concatenate(([0], np.cumsum(of_word)))
        alone = [self.model.encode(chunks[i], add_special_tokens=False).ids for i in odd]
        # the easy chunks' ids, the plain ones', then the others'; their places in the order of the numbers
        by_part = np.concatenate((np.flatnonzero(easy), np.array(plain + odd, np.int64)))
        ends = until[np.cumsum(np.concatenate((counts, np.array([len(x) for x in found], np.int64))))]
        sizes, place = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        sizes[by_part] = np.concatenate((np.diff(ends, prepend=0), np.array([len(x) for x in alone], np.int64)))
        place[by_part] = np.cumsum(sizes[by_part]) - sizes[by_part]
        self.chunks.ids.add(np.concatenate((ids, *[np.array(x, self.kind) for x in alone])), sizes, place)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' ids one after another, each text's followed by the end id; 1 where an id ends a chunk, else 0; and
        how many ids each text has. A null is an empty text."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        flat, stops = [np.empty(0, self.kind)], [np.empty(0, np.uint8)]
        sizes = np.zeros(len(texts), np.int64)
        for parts, owner, last in parts_of(texts):
            own, at, counts = coded_chunks(parts)
            found, unseen = self.chunks.numbers(own)
            if unseen:
                self._learn(unseen)
            # the end, which has number 0, after a text's last part
            numbers = np.insert(found[at], np.cumsum(counts)[last], 0)
            until = np.cumsum(counts + last)
            of_chunk = self.chunks.ids.sizes[numbers]
            # some at a time, so that the places of the ids stay few
            flat += [self.chunks.ids.take(numbers[i : i + EXPANDED])[0] for i in range(0, len(numbers), EXPANDED)]
            ends = np.concatenate(([0], np.cumsum(of_chunk)))
            stops.append(np.zeros(ends[-1], np.uint8))
            stops[-1][ends[1:][of_chunk > 0] - 1] = 1
            np.add.at(sizes, owner, np.diff(ends[until], prepend=0))
            self.chunks.forget(MEMO_CHUNKS)
            self.words.forget(MEMO_WORDS)
        return np.concatenate(flat), np.concatenate(stops), sizes


def id_type(ends: np.ndarray) -> str:
    """Little-endian unsigned integers that hold every id of the vocabulary."""
    return "<u2" if len(ends) <= 1 << 16 else "<u4"


def byte_level(text: str) -> str:
    """The text with each byte beyond ASCII as the character that stands for it in byte-level vocabularies."""
    raw = np.frombuffer(text.encode(), np.uint8)
    wide = raw >= 0x80
    until = np.cumsum(1 + wide)
    out = np.empty(until[-1] if len(raw) else 0, np.uint8)
    out[until - 1] = _LAST_BYTE[raw]
    out[until[wide] - 2] = _FIRST_BYTE[raw[wide]]
    return out.tobytes().decode()


def easy_words(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of chunks that match _EASY, one after another, and how many each chunk has."""
    raw, sizes = flat_values(pc.utf8_lower(chunks), "u1")
    if not len(raw):
        return pa.array([], pa.string()), sizes
    kind = _KINDS[raw]
    begins = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT), [True]))
    at = np.concatenate(([0], np.cumsum(sizes)))
    begins[at] = True
    words = np.flatnonzero(begins).astype(np.int32)
    return pa.StringArray.from_buffers(len(words) - 1, pa.py_buffer(words), pa.py_buffer(raw)), np.diff(np.searchsorted(words, at))


def coded_chunks(parts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks of the parts, the place among them of each chunk in order, and how many chunks each part has.

    White space is what it is to str.split(), but for _SEPARATORS. Beside white space at the ends there are empty chunks.
    """
    if (flat_values(parts, "u1")[0] - np.uint8(ord(_SEPARATORS[0])) < len(_SEPARATORS)).any():
        lists = pa.array([_SPACE.split(x) if any(c in x for c in _SEPARATORS) else x.split() for x in parts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(parts)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def distinct_chunks(parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """coded_chunks() of Python's strings."""
    own, at, counts = coded_chunks(pa.array(parts, pa.string()))
    return own.to_pylist(), at, counts


def parts_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The texts, long ones in slices, about TOGETHER at a time: the parts, the text of each, and 1 for the last of a text."""
    if len(texts) and pc.max(pc.binary_length(texts)).as_py() <= SLICE and pc.sum(pc.binary_length(texts)).as_py() <= TOGETHER + SLICE:
        yield texts, np.arange(len(texts)), np.ones(len(texts), bool)
        return
    parts: list[str] = []
    owner: list[int] = []
    last: list[bool] = []
    pending = 0
    for i, text in enumerate(texts):
        for part in slices(text.as_py()) if len(text.as_buffer()) else [""]:
            if pending >= TOGETHER:
                yield pa.array(parts, pa.string()), np.array(owner), np.array(last)
                parts, owner, last, pending = [], [], [], 0
            parts.append(part)
            owner.append(i)
            last.append(False)
            pending += len(part)
        last[-1] = True
    if parts:
        yield pa.array(parts, pa.string()), np.array(owner), np.array(last)


def slices(text: str) -> Iterator[str]:
    """The text in slices of about SLICE characters, cut at white space."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


MEMOS["tokens"] = _TOKENIZERS.clear


def tokenizer(path: str, end_id: int = END_ID) -> WordTokenizer:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


def chunk_terms(ids: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and term number of each chunk of documents as encode() gives them. A term is a hash of the chunk's ids."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(stops[:-1].view(bool)) + 1))
    until = np.searchsorted(first, np.cumsum(sizes))
    # a chunk's hash is the sum of its ids' (a difference of running sums) and the first one's twice more
    mixed = _mixed()[ids if ids.dtype.itemsize == 2 else ids & 0xFFFF]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    value = np.diff(total[first], append=total[-1:]) + (mixed[first] << np.uint64(1))
    # without the end, the last of a document
    keep = np.ones(len(first), bool)
    keep[until - 1] = False
    doc = np.repeat(np.arange(len(sizes)), np.diff(until, prepend=0) - 1)
    return doc, (mix64(value[keep]) >> np.uint64(64 - TERM_BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def _mixed() -> np.ndarray:
    return mix64(np.arange(1, (1 << 16) + 1))


@dataclass
class Statistics:
    """Of all documents: their number, their mean number of terms, and of each term the documents that have it."""

    n: int
    mean: float
    df: np.ndarray

    @cached_property
    def idf(self) -> np.ndarray:
        return self.rareness(self.df)

    @cached_property
    def route_idf(self) -> np.ndarray:
        return self.rareness(np.maximum(self.df, RARE))

    def rareness(self, df: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(0, self.n - df + 0.5) / (df + 0.5))

    def weight(self, idf: np.ndarray, tf: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of terms with these idf and frequencies in documents, which have these lengths."""
        return idf * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / max(1.0, self.mean)))[doc])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(first, append=len(values))


def route_levels(ids: np.ndarray, stops: np.ndarray, lengths: np.ndarray, statistics: Statistics) -> np.ndarray:
    """Of each document the hash of its strongest 1, 2, 4 and 8 terms that other documents have too."""
    n = len(lengths)
    doc, term = chunk_terms(ids, stops, lengths)
    sizes = np.bincount(doc, minlength=n)
    pairs, tf = distinct(doc << TERM_BITS | term)
    doc, term = pairs >> TERM_BITS, pairs & (TERM_SPACE - 1)
    shared = statistics.df[term] > 1
    doc, term, tf = doc[shared], term[shared], tf[shared]
    weight = statistics.weight(statistics.route_idf[term], tf, sizes, doc)
    # one sort: by document, descending weight and a number that spreads the terms, so that equal weights have one order
    falling = ((1 << 23) - np.minimum((1 << 23) - 1, weight * (1 << 16)).astype(np.int64)) << TERM_BITS
    spread = term * 0x9E375 & (TERM_SPACE - 1)
    ranked = np.sort(doc << (TERM_BITS + 24) | falling | spread)
    first = np.searchsorted(ranked, np.arange(n + 1) << (TERM_BITS + 24))
    found, h = [], np.zeros(n, np.uint64)
    for i in range(LEVELS[-1]):
        at = first[:-1] + i
        have = at < first[1:]
        one = np.zeros(n, np.int64)
        one[have] = (ranked[at[have]] & (TERM_SPACE - 1)) + 1
        h = mix64(h * np.uint64(31) + one.astype(np.uint64))
        if i + 1 in LEVELS:
            found.append((h >> np.uint64(64 - ROUTE_BITS)).astype(np.int64))
    return np.stack(found)


def routes(levels: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document its route, by how many documents have each value of each level."""
    route = np.full(levels.shape[1], -1, np.int64)
    for i, level in enumerate(levels):
        some = (route < 0) & (counts[i][level] <= ROUTE_DOCS)
        route[some] = i << ROUTE_BITS | level[some]
    rest = route < 0
    parts = -(-counts[-1][levels[-1][rest]].astype(np.int64) // ROUTE_DOCS)
    part = (mix64(rows[rest]) % parts.astype(np.uint64)).astype(np.int64)
    route[rest] = part << (ROUTE_BITS + 3) | len(LEVELS) << ROUTE_BITS | levels[-1][rest]
    return route


def count_slices(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for i, part in enumerate(counts.reshape(-1, SLICE_PLACES)):
        if part.any():
            yield i, part.astype("<i8").tobytes()


def add_slices(rows: DataFrame, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counts, and of TOTALS, over rows of (slice int, ids binary); as large for any number of rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_buffer(), "<i8")
                found[i] = found[i] + part if i in found else part.copy()
        small = [(v if i == TOTALS else np.minimum(v, 2**31 - 1).astype("<i4")).tobytes() for i, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(small, pa.binary())], names=["slice", "ids"])

    counts, totals = np.zeros(places, np.int32), np.zeros(2, np.int64)
    for i, raw in rows.repartition("slice").mapInArrow(add, "slice int, ids binary").collect():
        if i == TOTALS:
            totals = np.frombuffer(bytes(raw), "<i8")
        else:
            counts[i * SLICE_PLACES : (i + 1) * SLICE_PLACES] = np.frombuffer(bytes(raw), "<i4")
    return counts, totals


class Index:
    """BM25 postings over the documents of one shard; used documents are never returned.

    Frequencies and mean length are those of `statistics`, or without them the shard's own.
    """

    def __init__(self, terms: list[np.ndarray], statistics: Statistics | None = None) -> None:
        n = self.n = len(terms)
        sizes = np.array([len(t) for t in terms], np.int64)
        pairs = np.concatenate([np.repeat(np.arange(n), sizes) * TERM_SPACE + np.concatenate(terms)]) if n else np.empty(0, np.int64)
        pairs, tf = distinct(pairs)
        doc, term = pairs // TERM_SPACE, pairs % TERM_SPACE
        df = np.bincount(term, minlength=TERM_SPACE)
        if statistics is None:
            statistics = Statistics(n, sizes.mean() if n else 1.0, df)
        weight = statistics.weight(statistics.idf[term], tf, sizes, doc).astype(np.float32)
        keep = df[term] > 1  # a term of one document finds no other
        doc, term, weight = doc[keep], term[keep], weight[keep]
        common = df > max(2, COMMON * n)
        place = np.cumsum(common) - 1
        of = common[term]
        self.rows = np.zeros((np.count_nonzero(common), n), np.float32)
        self.rows[place[term[of]], doc[of]] = weight[of]
        # each document's terms: places among the rows, and numbers of lists of postings
        self.row_terms, self.row_from = place[term[of]], np.searchsorted(doc[of], np.arange(n + 1))
        doc, term, weight = doc[~of], term[~of], weight[~of]
        # one sort: by term and place
        ranked = np.sort(term << 40 | np.arange(len(term)))
        by_term = ranked & ((1 << 40) - 1)
        lengths = np.bincount(term)
        lengths = lengths[lengths > 0]
        self.query_terms, self.query_from = np.empty(len(term), np.int64), np.searchsorted(doc, np.arange(n + 1))
        self.query_terms[by_term] = np.repeat(np.arange(len(lengths)), lengths)
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        self.docs = np.arange(n)

    def keep(self, open_: np.ndarray) -> None:
        """Leave out the postings of documents that are not open; from now on only open ones are scored."""
        left = open_[self.docs]
        place = np.cumsum(left) - 1
        of = left[self.doc]
        self.first = np.concatenate(([0], np.cumsum(of)))[self.first]
        self.doc, self.weight = place[self.doc[of]], self.weight[of]
        self.rows = np.ascontiguousarray(self.rows[:, left])
        self.docs = self.docs[left]

    def scores(self, seed: int) -> np.ndarray:
        """The score of each of `docs` for all terms of the seed."""
        score = self.rows[self.row_terms[self.row_from[seed] : self.row_from[seed + 1]]].sum(0, dtype=np.float64)
        terms = self.query_terms[self.query_from[seed] : self.query_from[seed + 1]]
        begin = self.first[terms]
        at = stretches(begin, self.first[terms + 1] - begin)
        return score + np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.docs))

    def neighbours(self, seed: int, open_: np.ndarray, limit: int, scores: np.ndarray | None = None) -> np.ndarray:
        """The open documents with the highest scores for the seed; ties go to the earlier document."""
        score = self.scores(seed) if scores is None else scores
        found = np.flatnonzero((score > 0) & open_[self.docs])
        if len(found) > limit:
            least = np.partition(score[found], len(found) - limit)[len(found) - limit]
            found = found[score[found] >= least]
        return self.docs[found[np.lexsort((found, -score[found]))][:limit]]


def pack_shard(tokens: list[int], terms: list[np.ndarray], window: int, statistics: Statistics | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length)."""
    n = len(tokens)
    index = Index(terms, statistics)
    start = np.zeros(n, np.int64)
    rest = np.array(tokens, np.int64)
    for d in np.flatnonzero(rest >= window):
        for at in range(0, int(rest[d]) - window + 1, window):
            yield [(int(d), at, window)]
        start[d] = rest[d] // window * window
        rest[d] -= start[d]
    open_ = rest > 0
    order = np.lexsort((np.arange(n), -rest)).tolist()
    at = 0
    while True:
        if np.count_nonzero(open_) < KEEP * len(index.docs):
            index.keep(open_)
        while at < n and not open_[order[at]]:
            at += 1
        if at == n:
            return
        seed = order[at]
        pieces, room = [(seed, int(start[seed]), int(rest[seed]))], window - int(rest[seed])
        open_[seed] = False
        ahead = at
        scores = index.scores(seed) if room else None
        while room:
            near = index.neighbours(seed, open_, NEIGHBOURS, scores).tolist()
            if not near:  # no scored neighbour is left: the next open documents
                while ahead < n and len(near) < NEIGHBOURS:
                    if open_[order[ahead]]:
                        near.append(order[ahead])
                    ahead += 1
                if not near:
                    break
            for d in near:
                take = min(room, int(rest[d]))
                pieces.append((d, int(start[d]), take))
                room -= take
                start[d] += take
                rest[d] -= take
                open_[d] = rest[d] > 0
                if not room:
                    break
            ahead = at
        yield pieces


ENCODED = "doc_id long, row long, slice int, ids binary, stops binary"


def encoded_rows(doc_id: pa.Array, row: np.ndarray, slice_: pa.Array, ids: pa.Array, stops: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, pa.array(row, pa.int64()), slice_, ids, stops], names=["doc_id", "row", "slice", "ids", "stops"])


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, GROUP):
        yield batch.slice(at, GROUP)


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (doc_id, text) in groups that end with the row at which their ids and texts have TOGETHER bytes."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 8)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = min(int(np.searchsorted(ends, before + TOGETHER - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, n - at))
            size += int(ends[n - 1]) - before
            at = n
            if size >= TOGETHER:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into windows of at most `window` ids, neighbours together.

    Returns a row per piece: doc_id, start (ids of its document before it), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens (with the end id), sequence_id, offset (place in the window, gapless from 0). A null or empty
    text is the end id alone; a null or repeated doc_id is packed like any row; an empty table gives no rows; other
    columns are not read. Which documents share an index shard depends on the words of all of them and on the number of
    shuffle partitions, so windows may differ between runs with other settings; pieces cover each document all the same.
    """

    context = docs.sparkSession.sparkContext
    kind = WordTokenizer(tokenizer_path, end_id).kind

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("tokens")
        words = tokenizer(tokenizer_path, end_id)
        row = TaskContext.get().partitionId() << 36
        df, totals = np.zeros(TERM_SPACE, np.int64), np.zeros(2, "<i8")

        def rows_of(group: pa.RecordBatch) -> pa.RecordBatch:
            ids, stops, sizes = words.encode(group.column(1))
            doc, term = chunk_terms(ids, stops, sizes)
            np.add.at(df, distinct(doc << TERM_BITS | term)[0] & (TERM_SPACE - 1), 1)
            n = len(sizes)
            totals[:] += n, len(term)
            return encoded_rows(group.column(0), np.arange(row, row + n), pa.nulls(n, pa.int32()), binary_array(ids, sizes), binary_array(stops, sizes))

        for group in by_bytes(batches):
            yield rows_of(group)
            row += group.num_rows
            release()
        if totals[0]:
            numbers, parts = zip(*count_slices(df), (TOTALS, totals.tobytes()))
            n = len(numbers)
            yield encoded_rows(pa.nulls(n, pa.int64()), np.zeros(n, np.int64), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary()), pa.nulls(n, pa.binary()))

    encoded = stage(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(encode, ENCODED), "encoded")
    df, totals = add_slices(encoded.where("slice IS NOT NULL").select("slice", "ids"), TERM_SPACE)
    whole = context.broadcast(Statistics(int(totals[0]), float(totals[1] / max(1, totals[0])), df))
    encoded = encoded.where("slice IS NULL").select("doc_id", "row", "ids", "stops")

    def levels_of(ids: pa.Array, stops: pa.Array) -> np.ndarray:
        flat, lengths = flat_values(ids, kind)
        return route_levels(flat, flat_values(stops, "u1")[0], lengths, whole.value)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("shards")
        counts = np.zeros((len(LEVELS), 1 << ROUTE_BITS), np.int64)
        for batch in batches:
            for group in groups(batch):
                for own, level in zip(counts, levels_of(*group.columns)):
                    np.add.at(own, level, 1)
        rows = list(count_slices(counts))
        if rows:
            numbers, parts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "ids"])

    sizes, _ = add_slices(encoded.select("ids", "stops").mapInArrow(count, "slice int, ids binary"), len(LEVELS) << ROUTE_BITS)
    sizes = context.broadcast(sizes.reshape(len(LEVELS), -1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("shards")
        for batch in batches:
            for group in groups(batch):
                found = routes(levels_of(*group.columns[2:]), group.column(1).to_numpy(), sizes.value)
                yield pa.RecordBatch.from_arrays([*group.columns, pa.array(found, pa.int64())], names=["doc_id", "row", "ids", "stops", "route"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("shards")
        sequence = TaskContext.get().partitionId() << 36

        def shards() -> Iterator[pa.Table]:
            held, size = [], 0
            for batch in batches:
                tokens = np.cumsum(flat_values(batch.column(1), kind)[1])
                at = 0
                while at < batch.num_rows:
                    before = int(tokens[at - 1]) if at else 0
                    # up to the row that fills the shard
                    n = min(int(np.searchsorted(tokens, before + SHARD_TOKENS - size)) + 1, at + SHARD_DOCS - sum(map(len, held)), batch.num_rows)
                    held.append(batch.slice(at, n - at))
                    size += int(tokens[n - 1]) - before
                    at = n
                    if size >= SHARD_TOKENS or sum(map(len, held)) >= SHARD_DOCS:
                        yield pa.Table.from_batches(held)
                        held, size = [], 0
            if held:
                yield pa.Table.from_batches(held)

        def packed(shard: pa.Table) -> tuple[pa.RecordBatch, int]:
            chunks = [flat_values(c, kind) for c in shard.column(1).chunks]
            flat, tokens = (np.concatenate(x) for x in zip(*chunks))
            doc, term = chunk_terms(flat, np.concatenate([flat_values(c, "u1")[0] for c in shard.column(2).chunks]), tokens)
            cuts = np.searchsorted(doc, np.arange(len(tokens) + 1)).tolist()
            terms = [term[s:e] for s, e in zip(cuts, cuts[1:])]
            begin = np.cumsum(tokens) - tokens
            pieces, windows = [], []
            for found in pack_shard(tokens.tolist(), terms, window, whole.value):
                pieces += found
                windows.append(len(found))
            d, start, length = np.array(pieces, np.int64).T
            of = np.repeat(np.arange(len(windows)), windows)
            until = np.cumsum(length) - length
            offset = until - until[np.cumsum(windows) - windows][of]
            ids = ragged(flat, begin[d] + start, length).astype("<u4")
            numbers = [start, length, tokens[d], sequence + of, offset]
            start, length, doc_tokens, sequences, offset = (pa.array(x, pa.int64()) for x in numbers)
            doc_ids = shard.column(0).combine_chunks().take(pa.array(d))
            columns = [doc_ids, start, length, binary_array(ids, length.to_numpy()), doc_tokens, sequences, offset]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), len(windows)

        for shard in shards():
            found, n = packed(shard)
            yield found
            sequence += n
            release()

    routed = encoded.mapInArrow(route, "doc_id long, row long, ids binary, stops binary, route long")
    return routed.repartition("route").sortWithinPartitions("route", "row").select("doc_id", "ids", "stops").mapInArrow(pack, PIECES)
