"""Encoding of a whole corpus by a public byte-level BPE tokenizer (problem 6)."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_columns, shared_dir
from .transducer import Lexicon, compile_lexicon

#: Where the public vocabulary files are; every operator takes another path.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"

# The public tokenizer's pattern for words, and Unicode's white space.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Words never cross a blank between two visible characters, so a text falls into pieces there; a piece keeps
#: the blank before it. Where white space meets white space the pieces follow the pattern's own rules.
_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_DOUBLE = re.compile(f" [{SPACE}]|[{SPACE}] ")
_BLANKS = re.compile(f"[{SPACE}]").match
_WORDS = regex.compile(WORDS)

#: Entries that a worker's memo of pieces holds before it starts anew; it saves time, results don't depend on it.
MEMO = 300_000
LONG = 48
#: Frequent words that are compiled into the lexicon at most; the exact merge takes all others.
FREQUENT = 20_000
ROWS = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by the tokenizer's merges, lowest rank first, leftmost first among equals.

    Adjacent parts wait in a heap by rank and place; parts are a linked list, so a word of n bytes takes
    n log n steps however long it is.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that begins here; 0 once it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def pieces_of(text: str) -> tuple[list[str], list[str]]:
    """Pieces that can be encoded one by one: some as they stand, then others that lack their leading blank."""
    if _DOUBLE.search(text) or _BLANKS(text):
        return _PIECES.findall(text), []
    first, *rest = text.split(" ")
    return [first], rest


class Encoder:
    """Encodes texts; each distinct piece is looked up once, words in the lexicon, unseen ones by exact merge.

    Three memos: pieces as they stand, pieces behind a blank, words. Long pieces rarely recur and stay out.
    """

    def __init__(self, lexicon: Lexicon, memo: int = MEMO) -> None:
        self.lexicon, self.limit = lexicon, memo
        self.bare: dict[str, bytes] = {}
        self.blank: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @functools.cached_property
    def ranks(self) -> dict[bytes, int]:
        """The vocabulary, read from the mapped file once a word is met that the lexicon lacks."""
        return self.lexicon.vocabulary()

    def _learn(self, pieces: set[str], lead: str) -> dict[str, bytes]:
        split = [(p, _WORDS.findall(lead + p)) for p in pieces]
        fresh = list({w for _, words in split for w in words}.difference(self.words))
        if len(self.words) + len(fresh) > self.limit:
            self.words.clear()
            fresh = list({w for _, words in split for w in words})
        coded = [w.encode() for w in fresh]
        for word, code, number in zip(fresh, coded, self.lexicon.numbers(coded).tolist(), strict=True):
            found = self.lexicon.ids(number) if number >= 0 else np.array(merge_word(code, self.ranks), dtype="<i4")
            self.words[word] = found.tobytes()
        get = self.words.__getitem__
        return {p: b"".join(map(get, words)) for p, words in split}

    def _known(self, memo: dict[str, bytes], pieces: set[str], lead: str) -> dict[str, bytes]:
        """A table that holds all the pieces; the memo itself where nothing is new."""
        new = pieces.difference(memo)
        if not new:
            return memo
        if len(memo) + len(new) > self.limit:
            memo.clear()
            new = pieces
        learnt = self._learn(new, lead)
        memo.update((p, ids) for p, ids in learnt.items() if len(p) <= LONG)
        return {p: memo[p] if p in memo else learnt[p] for p in pieces}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers; null and empty texts have none."""
        cut = [pieces_of(text) if text else ([], []) for text in texts]
        bare = self._known(self.bare, set(chain.from_iterable(a for a, _ in cut)), "").__getitem__
        blank = self._known(self.blank, set(chain.from_iterable(b for _, b in cut)), " ").__getitem__
        return [b"".join([*map(bare, a), *map(blank, b)]) for a, b in cut]


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each stretch between blanks occurs in the whole corpus, those over LONG characters left out.

    Counted where the texts are read and flushed in parts of bounded size, so what is shuffled are distinct
    words with their counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if 0 < len(w) <= LONG]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    counts.update(value.split(" "))
                if len(counts) > MEMO:
                    yield flush()
        yield flush()

    parts = documents.select(text).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(documents: DataFrame, text: str = "text", most: int = FREQUENT) -> list[str]:
    """The words to compile: those that occur twice or more, the most frequent first, at most `most` (a bounded table)."""
    return [r.word for r in word_counts(documents, text).where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()]


@functools.lru_cache(maxsize=4)
def _ranks(path: str, _stamp: float) -> dict[bytes, int]:
    return read_ranks(path)


def lexicon_of(words: Iterable[str], ranks: dict[bytes, int]) -> bytes:
    """The compiled lexicon of the words that the tokenizer's pattern finds in the given stretches, each behind a blank;
    outputs are all ids of a word, one or several."""
    entries: dict[bytes, list[int]] = {}
    for stretch in words:
        for word in _WORDS.findall(" " + stretch):
            code = word.encode()
            if code not in entries:
                entries[code] = merge_word(code, ranks)
    return compile_lexicon(entries.items(), ranks)


def publish_lexicon(documents: DataFrame, text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER, most: int = FREQUENT) -> str:
    """Counts the corpus' words, compiles the frequent ones, puts the file in the shared folder and has Spark hand it to
    the executors; returns its name."""
    spark = documents.sparkSession
    path = os.path.join(tokenizer_dir, f"{tokenizer}.tiktoken")
    data = lexicon_of(frequent_words(documents, text, most), _ranks(path, os.path.getmtime(path)))
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    place = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(place)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        stream = fs.create(target, True)
        stream.write(data)
        stream.close()
    spark.sparkContext.addFile(fs.makeQualified(target).toString())
    return name


@functools.lru_cache(maxsize=2)
def worker_encoder(name: str) -> Encoder:
    """One per Python worker; the file is mapped, so workers of a machine share its pages."""
    return Encoder(Lexicon.open(SparkFiles.get(name)))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_corpus(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER
) -> DataFrame:
    """(doc_id, ids): every document's token ids without special tokens, one row in, one row out, no shuffle.

    A first pass counts the words of all texts; the frequent ones are compiled with their ids into a minimal automaton that
    every worker maps, and words which it lacks are merged exactly. Null and empty texts give an empty list; the strings of special
    tokens are ordinary text. Texts are encoded whole, whatever their length. Ids of documents may repeat or be null.
    """
    require_columns(documents, doc_id, text)
    name = publish_lexicon(documents, text, tokenizer_dir, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name)
        for batch in _slices(batches):
            packed = encoder.encode(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[doc_id, "ids"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def token_counts(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER
) -> DataFrame:
    """(doc_id, n_tokens): the length of every document in tokens; null and empty texts have 0."""
    require_columns(documents, doc_id, text)
    name = publish_lexicon(documents, text, tokenizer_dir, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name)
        for batch in _slices(batches):
            packed = encoder.encode(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[doc_id, "n_tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens bigint")
