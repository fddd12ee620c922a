"""Operator 7, lexical retrieval packing: a sharded BM25 index names the unused neighbours that fill a seed's window.

1. Texts are tokenized once. Terms are the lower-cased words, read back from their token ids. Document frequencies are
   counted over the whole corpus in ``CELLS`` hashed cells (one bounded vector, an upper bound of each word's frequency).
2. Documents are dealt to index shards by what they say: a document's keys are the pieces (words) that win weighted races (the
   least of an exponential draw a piece, divided by its weight), so that two documents have equal first keys with a
   probability equal to the similarity of their weighted word sets. A piece weighs the cube of its tokens, since the
   vocabulary gives common words few tokens and rare words many. Spark sorts all documents by these keys by ranges
   and each range is cut into equal shards of about ``SHARD_TOKENS`` tokens. Documents that say the same lie together at every size.
3. In a shard, a seed is scored by all its distinct words against all unused documents of the shard; the best fill its window
   of ``WINDOW`` tokens. The document that is cut goes on in the next window as its seed, so windows have no padding; the rest
   of a shard is cut into sequences of powers of two.

Every document is indexed and every seed searched by all its words, in its own shard. Work and shuffle grow with the tokens; nothing
about single documents reaches the driver. A neighbour in another shard is not found: README gives the measured share of
exhaustive search's neighbours that lie in the seed's shard.

Tokens of a text are those of its pieces: the vocabulary's rules never join across white space, nor letters and marks, so
that each worker has the library encode a piece once and looks it up afterwards.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows; a seed without
scored neighbours takes the next unused document of its shard; ties of score go to the one dealt first; extra columns are left out.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, read, small_batches, steps

WINDOW, SHARD_TOKENS, END = 4096, 2_000_000, 2
#: Cells of document frequencies, the slices in which they are summed, and bits of a word's hash that tell terms apart.
CELLS, SLICES, TERM_BITS = 1 << 20, 16, 40
#: Keys by which documents are dealt, and the power of a piece's tokens that is its weight in their races.
KEYS, POWER = 3, 3
#: Words in more than one of so many documents of a shard are kept as a matrix, all others as postings.
DENSE = 16
#: Distinct pieces a worker remembers, and the bytes that they and their tokens take; a step of texts comes on top.
PIECE_CACHE, PIECE_BYTES = 400_000, 128 << 20
#: Bytes of text that a step takes apart at once, and pieces whose words are counted at once: what a worker holds besides its table grows with both.
TEXT_BYTES, WORDS_OF = 1 << 20, 50_000
#: Bytes of a row group of the token table, and rows that Spark's Parquet reader takes at once: both are buffered on an executor's heap.
ROW_GROUP, READ_ROWS = 8 << 20, 512
#: Tokens of a piece that may stay when the table starts over.
SHORT = 16
#: Shards of a range that a task holds at most before it begins to pack, and tasks whose counts one group sums.
HELD_SHARDS, FAN = 16, 64
_SPACE, _LETTER, _MARK = r" \t-\r", "A-Za-z0-9À-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
OTHER = re.compile(f"[^{_SPACE}{_LETTER}{_MARK}]")
PLAIN = re.compile(f"[{_LETTER}]+|[{_MARK}]+")
MIXED = re.compile(f"[^{_SPACE}]*{OTHER.pattern}[^{_SPACE}]*|{PLAIN.pattern}")
K1, B = 1.2, 0.75
VOCABULARY = "word_bpe_49k.json"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """The parts of a text whose ids follow each other: runs of letters and digits, runs of marks, and whole words where
    other signs (apostrophes, which have rules of their own, among them) stand. A text that may hold a special token is one part."""
    if "<|" in text:
        return [text]
    text = text.lower() if text.isascii() else text.encode().lower().decode()
    return (MIXED if OTHER.search(text) else PLAIN).findall(text)


def _classes() -> np.ndarray:
    """What each byte of a text is: 0 space, 1 letter or part of one, 2 mark, 3 other."""
    kind = np.full(256, 3, np.uint8)
    for c in map(chr, range(128)):
        kind[ord(c)] = 0 if re.match(f"[{_SPACE}]", c) else 1 if re.match(f"[{_LETTER}]", c) else 2 if re.match(f"[{_MARK}]", c) else 3
    kind[0x80:0xC0] = kind[0xC3] = 1
    return kind


_CLASS = _classes()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def plain_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``pieces`` of all texts without other signs at once (null: empty): the pieces, the text of each, and the texts that have other signs or may hold a special token."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = _CLASS[raw]
    # The bytes of letters are those of U+00C0 to U+00FF, but for two signs; a continuation of any other lead byte comes with that lead, which is other.
    odd = np.flatnonzero(kind == 3)
    sign = np.flatnonzero(raw[:-1] == 0xC3)
    sign = sign[(raw[sign + 1] == 0x97) | (raw[sign + 1] == 0xB7)]
    special = np.flatnonzero(raw[:-1] == ord("<"))
    special = special[raw[special + 1] == ord("|")]
    rest = np.unique(np.searchsorted(at, np.concatenate((odd, sign, special)), side="right") - 1)
    for i in rest.tolist():
        kind[at[i] : at[i + 1]] = 0
    new = np.empty(len(raw), bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(raw)]] = True
    inside = kind != 0
    start = np.flatnonzero(new & inside)
    kept = _LOWER[raw[inside]]
    ends = np.append(np.cumsum(inside)[start] - 1, len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(kept))
    return found, np.searchsorted(at, start, side="right") - 1, rest


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def piece_numbers(found: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The distinct ones of ``plain_pieces``, those of up to 8 bytes (none of them 0) as numbers and the others as they are, and which of them each is."""
    if not len(found):
        return np.zeros(0, np.uint64), [], np.zeros(0, np.int64)
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int32)[: len(found) + 1]
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))
    size = np.diff(at)
    short = size <= 8
    number = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[at[:-1][short]] & _MASK[size[short]]
    few, many = found.filter(pa.array(~short)).dictionary_encode(), pa.array(number).dictionary_encode()
    which = np.empty(len(found), np.int64)
    which[short] = many.indices.to_numpy()
    which[~short] = few.indices.to_numpy() + len(many.dictionary)
    return many.dictionary.to_numpy().astype(np.uint64), few.dictionary.to_pylist(), which


def names_of(numbers: np.ndarray) -> list[str]:
    return [x.decode() for x in numbers.astype("<u8").view("S8").tolist()]


def distinct_pieces(found: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct ones of ``plain_pieces`` and which of them each is."""
    numbers, names, which = piece_numbers(found)
    return names_of(numbers) + names, which


class PieceTokens(dict):
    """Token ids of whole texts by a table of the pieces seen so far; the library encodes each piece once."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.name, self.time = np.zeros(0, np.int64), np.zeros((KEYS, 0))
        self.number, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.bytes = 0

    @property
    def full(self) -> bool:
        return len(self) > PIECE_CACHE or self.bytes > PIECE_BYTES

    def keep_common(self, seen: np.ndarray) -> None:
        """Starts over with the short pieces that most documents held (``seen``, by place), a quarter of the table at most."""
        most = PIECE_CACHE // 4
        least = max(1, int(np.partition(seen, -most)[-most])) if len(seen) > most else 1
        mask = np.zeros(len(self), bool)
        mask[: len(seen)] = (seen > least) & (self.n[: len(seen)] <= SHORT)
        names = [x for x, k in zip(self, mask.tolist()) if k]
        n, name, time = self.n[mask], self.name[mask], self.time[:, mask]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(self.at[mask] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        self._reset()
        self.update(zip(names, range(len(names))))
        self.flat, self.at, self.n, self.name, self.time = flat, ends - n, n, name, time
        self.bytes = _weight(names, n)

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place

    def _learn(self) -> None:
        """Adds the ids of the new pieces. A run of letters ends with its only word-end token, so that many are read from one encoding."""
        new, self.new = self.new, []
        flat, sizes = [], np.zeros(len(new), np.int64)
        plain = [i for i, x in enumerate(new) if x.isalpha()]
        rest = [i for i, x in enumerate(new) if not x.isalpha()]
        order: list[int] = []
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([new[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.word_end[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                flat.append(ids)
                sizes[part] = np.diff(cut, prepend=0)
                order += part
            else:
                rest += part
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)):
            flat.append(np.array(e.ids, np.uint32))
            sizes[i] = len(e.ids)
        order += rest
        at = np.zeros(len(new), np.int64)
        ends = np.cumsum(sizes[order])
        at[order] = len(self.flat) + ends - sizes[order]
        self.at, self.n, self.flat = np.append(self.at, at), np.append(self.n, sizes), np.concatenate((self.flat, *flat))
        name = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in new), np.uint64, len(new))
        with np.errstate(over="ignore"):
            draws = [mix(name + np.uint64(k + 1)) >> np.uint64(11) for k in range(KEYS)]
        time = -np.log((np.array(draws, np.float64) + 1) * 2.0**-53) / np.maximum(sizes, 1) ** POWER
        self.name, self.time = np.append(self.name, name.view(np.int64)), np.append(self.time, time, axis=1)
        self.bytes += _weight(new, sizes)

    def words(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The words of the pieces at these places, and the place of each; ``WORDS_OF`` pieces at a time."""
        for a in range(0, len(which), WORDS_OF):
            part = which[a : a + WORDS_OF]
            term, piece = words_of(*self.ids(part, np.ones(len(part), np.int64)), self.word_end)
            yield term, part[piece]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        k, sizes = self.places(texts)
        return self.ids(k, sizes)

    def places(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place in this table of each piece of the texts, one text after the other, and the number of pieces of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        plain, of, rest = plain_pieces(column)
        numbers, names, which = piece_numbers(plain)
        k = np.concatenate((self._short(numbers), np.fromiter(map(self.__getitem__, names), np.int64, len(names))))[which]
        sizes = np.bincount(of, minlength=len(column))
        if len(rest):
            # The few texts with other signs are taken apart one by one; all pieces are put in the order of the texts.
            split = [pieces(t) for t in column.take(pa.array(rest)).to_pylist()]
            sizes[rest] = np.fromiter(map(len, split), np.int64, len(split))
            of = np.append(of, np.repeat(rest, sizes[rest]))
            k = np.append(k, np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, len(of) - len(k)))[np.argsort(of, kind="stable")]
        if self.new:
            self._learn()
        return k, sizes

    def _short(self, numbers: np.ndarray) -> np.ndarray:
        """The places of short pieces given as numbers; those met before are found in a sorted array, so that only new ones become strings."""
        at = np.searchsorted(self.number, numbers)
        known = np.zeros(len(numbers), bool)
        inside = at < len(self.number)
        known[inside] = self.number[at[inside]] == numbers[inside]
        places = np.empty(len(numbers), np.int64)
        places[known] = self.place[at[known]]
        names = names_of(numbers[~known])
        places[~known] = np.fromiter(map(self.__getitem__, names), np.int64, len(names))
        order = np.flatnonzero(~known)[np.argsort(numbers[~known])]
        self.number, self.place = np.insert(self.number, at[order], numbers[order]), np.insert(self.place, at[order], places[order])
        return places

    def ids(self, k: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[k]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[k] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[np.cumsum(sizes)]


def _weight(names: list[str], sizes: np.ndarray) -> int:
    """Bytes of pieces: the text, its entries in the table and the counts, and its ids, which are copied when the table grows."""
    return sum(map(sys.getsizeof, names)) + 200 * len(names) + 8 * int(sizes.sum())


def worker_tokens(path: str) -> PieceTokens:
    """The table of this worker process, which serves task after task; it starts over between steps of texts once it holds too much."""
    held = sys.__dict__.setdefault("_piece_tokens", {})
    if path not in held:
        held[path] = PieceTokens(path)
    return held[path]


def words_of(ids: np.ndarray, ends: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash (``TERM_BITS`` bits) and the document of each word: token ids up to one that ends a word, or the text."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = word_end[ids].copy()
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.append(0, stop[:-1])
    place = np.arange(len(ids), dtype=np.int32 if len(ids) < 1 << 31 else np.int64)
    place -= np.repeat(start.astype(place.dtype), stop - start)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))[place]
        del place
        value = ids.astype(np.uint64)
        value += np.uint64(1)
        value *= power
        term = mix(np.add.reduceat(value, start))
    return term & np.uint64((1 << TERM_BITS) - 1), np.searchsorted(ends, start, side="right")


def distinct_words(term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and count of the distinct pairs, in order."""
    cell, tf = np.unique(doc.astype(np.uint64) << np.uint64(TERM_BITS) | term, return_counts=True)
    return (cell >> np.uint64(TERM_BITS)).astype(np.int64), cell & np.uint64((1 << TERM_BITS) - 1), tf


def _cell(term: np.ndarray) -> np.ndarray:
    return (term & np.uint64(CELLS - 1)).astype(np.int64)


_KEYS = [f"k{k}" for k in range(KEYS)]
_TOKENS = f"uid long, doc_id long, ids binary, {', '.join(f'{k} long' for k in _KEYS)}, part int, cells binary, counts binary, docs long, tokens long"
_TYPES = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * KEYS, pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _TOKENS.split(", ")]


def race_keys(k: np.ndarray, sizes: np.ndarray, time: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Keys x texts: the piece that wins each race of a text; -1 where there are none."""
    keys = np.full((len(time), len(sizes)), -1, np.int64)
    some = sizes > 0
    head = (np.cumsum(sizes) - sizes)[some]
    if len(head):
        doc = np.repeat(np.flatnonzero(some), sizes[some])
        for key, t in zip(keys, time):
            t = t[k]
            won = np.flatnonzero(t == np.repeat(np.minimum.reduceat(t, head), sizes[some]))
            key[doc[won]] = name[k[won]]
    return keys


def _tokenize(path: str, narrow: type) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, docs, tokens = worker_tokens(path), 0, 0
        first = TaskContext.get().partitionId() << 36
        df, held = np.zeros(CELLS, np.int32), np.zeros(0, np.int32)
        rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

        def count() -> None:
            """Adds the documents of each piece to the cells of its words."""
            for term, piece in table.words(np.flatnonzero(held)):
                np.add.at(df, _cell(term), held[piece])

        for batch in steps(batches, most=TEXT_BYTES):
            if table.full:
                count()
                table.keep_common(held)
                held = np.zeros(0, np.int32)
            k, sizes = table.places(batch.column("text"))
            ids, ends = table.ids(k, sizes)
            pairs = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 32 | k)
            seen = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] & 0xFFFFFFFF, minlength=len(table)).astype(np.int32)
            seen[: len(held)] += held
            held = seen
            n, size = len(ends), np.dtype(narrow).itemsize
            raw, at = ids.astype(narrow).tobytes(), np.append(0, ends) * size
            none = [None] * n
            keys = race_keys(k, sizes, table.time, table.name)
            yield rows(first + docs + np.arange(n), batch.column("doc_id"), [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], *keys, *[none] * 5)
            docs, tokens = docs + n, tokens + len(ids)
        if docs:
            count()
            some = np.flatnonzero(df).astype(np.int32)
            cut_at = np.searchsorted(some, np.arange(SLICES + 1) * (CELLS // SLICES))
            parts = [some[a:b] for a, b in zip(cut_at[:-1], cut_at[1:])]
            none = [None] * SLICES
            yield rows([first >> 36] * SLICES, none, none, *[none] * KEYS, range(SLICES), [c.tobytes() for c in parts], [df[c].tobytes() for c in parts], *([x, *[0] * (SLICES - 1)] for x in (docs, tokens)))
        # The worker outlives the task; what Arrow keeps of its batches does not.
        pa.default_memory_pool().release_unused()

    return run


def _sum_slices(key: tuple, table: pa.Table) -> pa.Table:
    part, group, width = key[0].as_py(), key[1].as_py(), CELLS // SLICES
    total = np.zeros(width, np.int64)
    for cells, counts in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist()):
        # Of one row each cell comes once; sums of tasks hold all cells of their slice.
        if cells is None:
            total += np.frombuffer(counts, np.int64)
        else:
            total[np.frombuffer(cells, np.int32) - part * width] += np.frombuffer(counts, np.int32)
    sums = [sum(table.column(c).to_pylist()) for c in ("docs", "tokens")]
    column = lambda x, kind: pa.array([x], kind)
    return pa.table({"part": column(part, pa.int32()), "task": column(group, pa.int64()), "cells": column(None, pa.binary()), "counts": column(total.tobytes(), pa.binary()), "docs": column(sums[0], pa.int64()), "tokens": column(sums[1], pa.int64())})


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of each cell, number of documents and of tokens, over the whole corpus.

    Each task's counts are summed slice by slice on the executors, by a tree: a group takes ``FAN`` rows at most, whatever the number of tasks. A vector of ``CELLS`` numbers
    reaches the driver.
    """
    parts = tokens.where("part IS NOT NULL").select("part", F.col("uid").alias("task"), "cells", "counts", "docs", "tokens")
    tasks = int(tokens.where("part IS NOT NULL").agg(F.coalesce(F.max("uid"), F.lit(-1))).first()[0]) + 1
    while True:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("task", F.expr(f"task DIV {FAN}")).groupBy("part", "task").applyInArrow(_sum_slices, "part int, task long, cells binary, counts binary, docs long, tokens long")
        if tasks <= 1:
            break
        parts = materialize(parts, "cell-sums")
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    df = np.concatenate([np.frombuffer(bytes(r["counts"]), np.int64) for r in rows]) if rows else np.zeros(CELLS, np.int64)
    return df, sum(r["docs"] for r in rows), sum(r["tokens"] for r in rows)


def _ids_of(parts: list[bytes], narrow: type) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), narrow), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // np.dtype(narrow).itemsize


class ShardIndex:
    """BM25 postings of the documents of one shard, by word."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> None:
        """``sizes`` are the documents' tokens, ``mean`` their mean over the corpus; ``idf`` has a value per cell."""
        self.n = len(sizes)
        doc, term, tf = distinct_words(term, doc)
        impact = idf[_cell(term)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.doc_ptr = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term)
        new = np.diff(term[order], prepend=np.uint64(1 << 63)) != 0
        self.code = np.empty(len(term), np.int32)
        self.code[order] = np.cumsum(new) - 1
        self.ptr = np.append(np.flatnonzero(new), len(term))
        self.docs, self.impact = doc[order].astype(np.int32), impact[order]
        common = np.flatnonzero(np.diff(self.ptr) * DENSE > max(self.n, 8 * DENSE))
        self.row = np.full(len(self.ptr) - 1, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for i, c in enumerate(common.tolist()):
            a, b = self.ptr[c], self.ptr[c + 1]
            self.dense[i, self.docs[a:b]] = self.impact[a:b]
        self.used = np.zeros(self.n, bool)

    def neighbours(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The unused documents that share a word with the seed, and their scores."""
        code = self.code[self.doc_ptr[seed] : self.doc_ptr[seed + 1]]
        row = self.row[code]
        rare = code[row < 0]
        start = self.ptr[rare]
        count = self.ptr[rare + 1] - start
        total = int(count.sum())
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)
        docs = self.docs[at]
        # Few postings are summed by themselves, many in a vector of all documents.
        if len(rare) == len(code) and total < self.n >> 3:
            docs, inverse = np.unique(docs, return_inverse=True)
            scores = np.bincount(inverse, self.impact[at], len(docs))
        else:
            scores = np.bincount(docs, self.impact[at], self.n) + self.dense[row[row >= 0]].sum(axis=0, dtype=np.float64)
            docs = np.arange(self.n)
        keep = (scores > 0) & ~self.used[docs]
        return docs[keep], scores[keep]


def best_first(docs: np.ndarray, scores: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """The best-scored documents until their lengths fill the room; ties go to the smaller number."""
    k = 32
    while True:
        top = np.argpartition(-scores, k - 1)[:k] if k < len(docs) else np.arange(len(docs))
        if k < len(docs):
            # All ties of the last one are looked at.
            top = np.flatnonzero(scores >= scores[top].min())
        top = top[np.lexsort((docs[top], -scores[top]))]
        before = np.cumsum(lengths[docs[top]]) - lengths[docs[top]]
        if k >= len(docs) or before[-1] + lengths[docs[top[-1]]] >= room:
            return docs[top[before < room]]
        k *= 8


def reading_order(index: ShardIndex, lengths: np.ndarray, window: int) -> np.ndarray:
    """The shard's documents in the order in which seeds and their unused neighbours fill window after window."""
    order = np.empty(index.n, np.int64)
    placed, room, nxt, last = 0, window, 0, -1
    wordless = np.diff(index.doc_ptr) == 0
    while placed < index.n:
        if room <= 0:
            # The document cut by the window's end, or the last one in it, seeds the next window.
            room += (-room // window + 1) * window
        found = best_first(*index.neighbours(last), lengths, room) if last >= 0 and not wordless[last] else ()
        if not len(found):
            while index.used[nxt]:
                nxt += 1
            end = nxt + 1
            if wordless[nxt]:
                # Texts without words have no neighbours: as many as follow each other go in at once.
                stop = np.flatnonzero(~wordless[nxt:] | index.used[nxt:])
                end = nxt + int(stop[0]) if len(stop) else index.n
            found = np.arange(nxt, end)
        index.used[found] = True
        order[placed : placed + len(found)] = found
        placed, room, last = placed + len(found), room - int(lengths[found].sum()), int(found[-1])
    return order


def cut(lengths: np.ndarray, window: int) -> np.ndarray:
    """Lengths of the sequences that hold so many tokens: full windows, then powers of two."""
    total = int(lengths.sum())
    rest = total % window
    return np.array([window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def equal_cuts(sizes: list[int], n: int) -> list[int]:
    """Where to end each of at most ``n`` runs of nearly equal sums, none of them empty."""
    ends = np.cumsum(sizes)
    stops = np.searchsorted(ends, ends[-1] * np.arange(1, n) / n, side="left") + 1
    return np.unique(np.append(stops, len(sizes))).tolist()


def _pack_shards(path: str, shared, mean: float, window: int, narrow: type, with_ids: bool) -> Callable:
    """Reads a range of the dealt documents shard by shard and packs each."""

    def pack_shard(doc_ids: list, parts: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        ids, ends = _ids_of(parts, narrow)
        term, doc = words_of(ids, ends, worker_tokens(path).word_end)
        sizes = np.diff(ends, prepend=0)
        lengths = sizes + 1
        index = ShardIndex(term, doc, sizes, shared.value, mean)
        order = reading_order(index, lengths, window)
        doc_end = np.cumsum(lengths[order])
        sequences = np.cumsum(cut(lengths, window))
        bounds = np.unique(np.concatenate((doc_end, sequences)))
        begin = np.append(0, bounds[:-1])
        place = np.searchsorted(doc_end, begin, side="right")
        seq = np.searchsorted(sequences, begin, side="right")
        doc = order[place]
        start = begin - (doc_end - lengths[order])[place]
        length = bounds - begin
        offset = begin - np.append(0, sequences[:-1])[seq]
        whole = np.insert(ids.astype("<u4"), ends, END)
        base = (ends - sizes + np.arange(len(ends)))[doc] + start
        crc = [zlib.crc32(whole[a : a + n]) for a, n in zip(base.tolist(), length.tolist())]
        columns = {
            "doc_id": pa.array(doc_ids, pa.int64()).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(lengths[doc]), "sequence_id": pa.array(seq + first), "offset": pa.array(offset),
        }
        if with_ids:
            columns["ids"] = pa.array([whole[a : a + n].tobytes() for a, n in zip(base.tolist(), length.tolist())], pa.binary())
        return pa.RecordBatch.from_pydict(columns), len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc_ids, parts, sizes, held, first = [], [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                doc_ids.append(doc_id)
                parts.append(ids)
                sizes.append(len(ids) // np.dtype(narrow).itemsize + 1)
                held += sizes[-1]
            while held > HELD_SHARDS * SHARD_TOKENS:
                n = equal_cuts(sizes, HELD_SHARDS)[0]
                out, k = pack_shard(doc_ids[:n], parts[:n], first)
                yield out
                held, first = held - sum(sizes[:n]), first + k
                del doc_ids[:n], parts[:n], sizes[:n]
        # What a range holds in the end is cut into shards of equal tokens, so that no remnant is left to itself.
        a = 0
        for b in equal_cuts(sizes, max(1, round(held / SHARD_TOKENS))) if sizes else ():
            out, k = pack_shard(doc_ids[a:b], parts[a:b], first)
            yield out
            a, first = b, first + k
        pa.default_memory_pool().release_unused()

    return run


def dealt(docs: DataFrame, path: str, narrow: type) -> tuple[DataFrame, np.ndarray, float]:
    """doc_id, ids and keys of all documents, sorted by keys in ranges; each cell's weight and the mean tokens of the corpus."""
    tokens = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(path, narrow), _TOKENS), "tokens", **{"parquet.block.size": ROW_GROUP})
    df, n, total = statistics(tokens)
    idf = np.log1p(np.maximum(n - df + 0.5, 0.5) / (df + 0.5)).astype(np.float32)
    keys = [*_KEYS, F.xxhash64("uid")]
    ranges = tokens.where("part IS NULL").select("uid", "doc_id", "ids", *_KEYS).repartitionByRange(max(1, -(-total // SHARD_TOKENS)), *keys).sortWithinPartitions(*keys)
    return ranges, idf, max(1.0, total / max(1, n))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; ``with_ids`` adds its ids (little-endian unsigned 32-bit)."""
    path = path or vocabulary_path()
    narrow = np.uint16 if len(worker_tokens(path).word_end) <= 1 << 16 else np.uint32
    ranges, idf, mean = dealt(docs, path, narrow)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    schema = _PIECE + (", ids binary" if with_ids else "")
    return ranges.select("doc_id", "ids").mapInArrow(_pack_shards(path, shared, mean, window, narrow, with_ids), schema)


def small_reads(spark: SparkSession) -> None:
    """Bounds what Spark reads of long texts and token rows at once. The settings stay with the session, as the returned plan runs later."""
    small_batches(spark, 1000, TEXT_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_reads(spark)
    return pack(read(spark, sf_dir, "documents"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents that came through.

    Defined results: those of ``pack``; a null doc_id stays null; extra columns are left out, whatever their names.
    """
    small_reads(spark)
    return pack(docs)
