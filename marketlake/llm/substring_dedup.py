"""Operator 3, substring dedup by recompression.

Tokens become symbols; each round names runs of equal symbols and then pairs (a coin on the symbol says which may come first),
so that equal substrings get equal interior symbols at every level, whatever surrounds them. Names are content
hashes, which all tasks agree on without a dictionary to shuffle. Every symbol carries its context, the words that
decide it. A window picks as its anchor, among the symbols of the highest level whose context lies inside it, the
longest (ties: least name): equal windows pick equal anchors wherever they stand.

Neighbouring windows of one anchor form a segment. Anchors that only one document has end there. Of the rest,
segments of equal words (128-bit names) are judged whole; where an anchor has several kinds of segment, one copy
of each kind is verified window by window. Rows shuffled grow with the text, not with pairs; groups are combined on the map side.

Defined results: a null or empty text has no words; a null doc_id counts as the largest; rows that repeat a
doc_id and text get equal results and never remove each other; documents shorter than a window stay whole; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WideWordHashes, drop_table, materialize, mix, read, small_batches, steps, text_bytes

WINDOW, ROUNDS = 50, 3
_Q = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class RangeHashes:
    """128-bit names of word ranges, from prefix sums of each half of the words' hashes times powers."""

    def __init__(self) -> None:
        self.size = 0

    def load(self, halves: np.ndarray) -> None:
        n = halves.shape[1]
        if n > self.size:
            self.size = max(n, 2 * self.size)
            self.powers = []
            for q in _Q:
                inverse = np.uint64(pow(int(q), -1, 1 << 64))
                rows = []
                for base in (q, inverse):
                    p = np.full(self.size + 1, base, np.uint64)
                    p[0] = 1
                    rows.append(np.multiply.accumulate(p))
                self.powers.append(rows)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n]))) for words, (up, _) in zip(halves, self.powers)]

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mix((s[end] - s[start]) * down[start]) for s, (_, down) in zip(self.sums, self.powers)]


def recompress(words: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int) -> list[tuple[np.ndarray, ...]]:
    """Levels of (name, length, context start + 1, context end), from the words up.

    ``first`` and ``last`` mark the words at the ends of documents, beyond which no symbol reaches.
    """
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    name, length, cs, ce = words, np.ones(n, np.int64), at + 1, at + 1
    begin, end = at, at + 1
    levels = [(name, length, cs, ce)]
    for r in range(rounds):
        # Runs: a symbol is known once its neighbours are known to differ.
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & ~first[1:]
        head = np.flatnonzero(~same)
        count = np.diff(np.append(head, len(name)))
        tail = head + count - 1
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(name) - 1)
        run_cs = np.where(first[head], begin[head], cs[before])
        run_ce = np.where(last[tail], end[tail] + 1, ce[after])
        total = np.add.reduceat(length, head) if len(head) else length
        run_name = np.where(count > 1, mix(name[head] + mix(count.astype(np.uint64) + np.uint64(977 * (r + 1)))), name[head])
        name, length, cs, ce, first, last = run_name, total, run_cs, run_ce, first[head], last[tail]
        begin, end = begin[head], end[tail]
        # Pairs: a left symbol joins the right symbol after it.
        left = (mix(name ^ np.uint64(0xA5A5A5A5 + r)) & np.uint64(1)).astype(bool)
        join = np.zeros(len(name), bool)
        join[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
        joined = np.zeros(len(name), bool)
        joined[1:] = join[:-1]
        lo, hi = cs.copy(), ce.copy()
        lo[1:] = np.where(~left[1:], cs[:-1], lo[1:])
        lo = np.where(~left & first, begin, lo)
        hi[:-1] = np.where(left[:-1], ce[1:], hi[:-1])
        hi = np.where(left & last, end + 1, hi)
        keep = np.flatnonzero(~joined)
        other = np.minimum(keep + 1, len(name) - 1)
        two = join[keep]
        pair = mix(name[keep] * np.uint64(3) + mix(name[other] + np.uint64(r + 1)))
        cs = np.where(two, cs[keep], lo[keep])
        ce = np.where(two, ce[other], hi[keep])
        length = np.where(two, length[keep] + length[other], length[keep])
        first, last = first[keep], np.where(two, last[other], last[keep])
        begin, end = begin[keep], np.where(two, end[other], end[keep])
        name = np.where(two, pair, name[keep])
        levels.append((name, length, cs, ce))
    return levels


def _argmin_ranges(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each range lo..hi (not empty), the leftmost index of the least value."""
    table, step = [np.arange(len(value))], 1
    width = hi - lo
    while 2 * step <= width.max(initial=1):
        a, b = table[-1][:-step], table[-1][step:]
        table.append(np.where(value[b] < value[a], b, a))
        step *= 2
    k = np.frexp(width)[1] - 1
    out = np.empty(len(lo), np.int64)
    for level, t in enumerate(table):
        m = k == level
        if m.any():
            a, b = t[lo[m]], t[hi[m] - (1 << level)]
            out[m] = np.where(value[b] < value[a], b, a)
    return out


def anchors(words: np.ndarray, sizes: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, and the name and place (distinct per symbol) of each window's anchor."""
    n = len(words)
    ends = np.cumsum(sizes)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[(ends - sizes)[sizes > 0]] = True
    last[ends[sizes > 0] - 1] = True
    counts = np.maximum(sizes - window + 1, 0)
    starts = np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    names = np.zeros(len(starts), np.uint64)
    places = np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    levels = recompress(words, first, last, rounds)
    for depth in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        name, length, cs, ce = levels[depth]
        w = starts[todo]
        lo = np.cumsum(np.bincount(cs, minlength=n + 2))[w]
        hi = np.cumsum(np.bincount(ce, minlength=n + 2))[w + window]
        fits = hi > lo
        value = ((np.uint64(255) - np.minimum(length, 255).astype(np.uint64)) << np.uint64(56)) | (name >> np.uint64(8))
        if fits.any():
            best = _argmin_ranges(value, lo[fits], hi[fits])
            names[todo[fits]] = name[best]
            places[todo[fits]] = best * len(levels) + depth
        todo = todo[~fits]
    return starts, names, places


_SEGMENT = "anchor long, h1 long, h2 long, _id long, _th long, start int, n int"
_WINDOW = "h1 long, h2 long, _id long, _th long, start int"


def _words_of(batch: pa.RecordBatch, cache: WideWordHashes) -> tuple[np.ndarray, np.ndarray]:
    split = [b.split() for b in text_bytes(batch.column("text"))]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return cache.of([w for doc in split for w in doc]), sizes


def _segments(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ranges = WideWordHashes(), RangeHashes()
        with np.errstate(over="ignore"):
            for batch in steps(batches):
                words, sizes = _words_of(batch, cache)
                starts, names, places = anchors(words[0], sizes, window, rounds)
                if not len(starts):
                    continue
                doc_start = np.cumsum(sizes) - sizes
                doc = np.searchsorted(doc_start + sizes, starts, side="right")
                new = np.ones(len(starts), bool)
                new[1:] = (places[1:] != places[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(starts)))
                s = starts[head]
                ranges.load(words)
                h1, h2 = ranges.of(s, s + count + window - 1)
                of = doc[head]
                # Equal windows that follow each other (runs of one word) are one row.
                new = np.ones(len(s), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (s[1:] != s[:-1] + 1) | (count[1:] > 1) | (count[:-1] > 1) | (of[1:] != of[:-1])
                rows = np.flatnonzero(new)
                count = np.where(count[rows] > 1, count[rows], np.diff(np.append(rows, len(s))))
                s, h1, h2, of, head = s[rows], h1[rows], h2[rows], of[rows], head[rows]
                ids, ths = batch.column("_id").to_numpy()[of], batch.column("_th").to_numpy()[of]
                columns = [names[head].view(np.int64), h1.view(np.int64), h2.view(np.int64), ids, ths, (s - doc_start[of]).astype(np.int32), count.astype(np.int32)]
                table = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "h1", "h2", "_id", "_th", "start", "n"])
                yield table

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ranges = WideWordHashes(), RangeHashes()
        with np.errstate(over="ignore"):
            for batch in steps(batches):
                words, sizes = _words_of(batch, cache)
                base = np.cumsum(sizes) - sizes
                pieces, docs = [], []
                for i, (starts, ns) in enumerate(zip(batch.column("starts"), batch.column("ns"))):
                    a, k = np.array(starts.as_py(), np.int64), np.array(ns.as_py(), np.int64)
                    each = np.unique(np.repeat(a - (np.cumsum(k) - k), k) + np.arange(k.sum()))
                    pieces.append(each + base[i])
                    docs.append(np.full(len(each), i))
                if not pieces:
                    continue
                s, of = np.concatenate(pieces), np.concatenate(docs)
                ranges.load(words)
                h1, h2 = ranges.of(s, s + window)
                ids, ths = batch.column("_id").to_numpy()[of], batch.column("_th").to_numpy()[of]
                columns = [h1.view(np.int64), h2.view(np.int64), ids, ths, (s - base[of]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "_id", "_th", "start"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, ns in zip(text_bytes(batch.column("text")), batch.column("starts"), batch.column("ns")):
                words = text.split()
                n_words.append(len(words))
                if starts.is_valid:
                    a, k = np.array(starts.as_py(), np.int64), np.array(ns.as_py(), np.int64)
                    edge = np.bincount(a, minlength=len(words) + 1) - np.bincount(np.minimum(a + k + window - 1, len(words)), minlength=len(words) + 1)
                    out = np.cumsum(edge)[: len(words)] > 0
                    n_removed.append(int(out.sum()))
                    words = [w for w, gone in zip(words, out.tolist()) if not gone]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            columns = [batch.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_words", "n_removed", "kept"])

    return run


NO_ID = (1 << 63) - 1


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_th"), "text")
    # Tables of keys are written before they are joined: both sides are then plain exchanges, whose hot keys Spark splits.
    segments = materialize(docs.mapInArrow(_segments(window, rounds), _SEGMENT), "segments")
    shared = (
        segments.groupBy("anchor")
        .agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.min("h1").alias("least"), F.max("h1").alias("most"))
        .where("lo < hi")
        .select("anchor", (F.col("least") != F.col("most")).alias("several"))
    )
    candidates = materialize(segments.join(materialize(shared, "shared"), "anchor"), "candidates")
    drop_table(segments)
    kinds = candidates.groupBy("h1", "h2").agg(F.min("_id").alias("origin"))
    judged = materialize(candidates.join(materialize(kinds, "kinds"), ["h1", "h2"]).drop("anchor", "h1", "h2"), "judged")
    drop_table(candidates)
    per_doc = [F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")]
    whole = judged.where("_id > origin").select("_id", "_th", "start", "n")
    # Rows that repeat a document (all without id, say) give equal segments; each is gathered once.
    unclear = judged.where("_id = origin and several").select("_id", "_th", "start", "n").distinct().groupBy("_id", "_th").agg(*per_doc)
    windows = materialize(docs.join(unclear, ["_id", "_th"]).mapInArrow(_windows(window), _WINDOW), "windows")
    origins = windows.groupBy("h1", "h2").agg(F.min("_id").alias("origin"), F.max("_id").alias("latest")).where("origin < latest")
    parts = windows.join(materialize(origins, "origins"), ["h1", "h2"]).where("_id > origin").select("_id", "_th", "start", F.lit(1).alias("n"))
    ranges = whole.unionByName(parts).distinct().groupBy("_id", "_th").agg(*per_doc)
    done = docs.join(ranges, ["_id", "_th"], "left").select("_id", "text", "starts", "ns")
    kept = done.mapInArrow(_remove(window), "_id long, n_words long, n_removed long, kept string")
    return kept.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "n_words", "n_removed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 1000)
    kept = dedup_substrings(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
