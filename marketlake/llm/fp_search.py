"""Operator 13, ranked lexical search: document FP-trees and branch and bound.

Each document is restricted to the terms of the items at hand and its terms are ordered by document frequency, most frequent
first, so that documents share paths of a trie. A node knows the greatest tf of each term below it and the least m (and id), which give
an upper bound of any item's score below it. Per item a depth-first walk takes the child of greatest bound first and leaves out every
subtree whose bound cannot reach the item's k best so far.

Pass one tokenizes each text once, where it is read, and writes the restricted vectors; counts (N, L, df) are exact aggregations over all documents. Pass
two builds trees of at most ``TREE`` entries in the tasks that read the vectors and walks them for all items; a task carries its k best per item from tree to
tree. The tasks' best are merged by two ranked windows. Items come in blocks of about ``BLOCK`` terms, each block against all documents, so that what travels to
every task has a fixed greatest size (or is one item).

Defined results: a null text has no terms; documents without terms take part in nothing; items without terms, or that no document matches,
have no rows; rows that repeat an item's id are one item with all their terms (a null id is an id); rows that repeat a document are
documents of their own; of equal scores the smaller id comes first, null ids last; texts are read whole, whatever their length; extra columns are
not looked at; empty tables give no rows. Ids of documents are integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, read, small_batches, steps, text_bytes
from .sharding import prefix_sums

K = 10
#: Entries (document, term) of one tree at most, a larger document apart; documents of a leaf; terms of a block of items.
TREE, LEAF, BLOCK = 1 << 19, 16, 1 << 16
#: Groups in which the tasks' best are merged first.
SALT = 64
NO_ID = np.iinfo(np.int64).max

#: Terms are runs of ASCII letters and digits and of all non-ASCII bytes; A-Z become a-z, every other ASCII byte a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class Tree:
    """A trie of restricted documents, path-compressed: nodes are ranges of the documents sorted by their term sequences."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """``terms`` are ranks by document frequency (0 the most frequent), ascending within each document; ``sizes`` their number."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        big = terms.astype(">u4")
        names = [big[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        order = sorted(range(len(names)), key=lambda i: (names[i], m[i], ids[i]))
        names = [names[i] for i in order]
        at = np.array(order, np.int64)
        self.ids, self.m, self.sizes = ids[at], m[at], sizes[at]
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        entries = np.repeat(starts[at] - self.starts, self.sizes) + np.arange(int(self.ends[-1]))
        self.terms, tf = terms[entries], tfs[entries]
        doc = np.repeat(np.arange(len(at)), self.sizes)
        self.parts = _part(tf, self.m[doc])
        shared = np.array([0, *(_shared(a, b) for a, b in zip(names, names[1:]))], np.int64)
        self._grow(shared)
        self._bound(doc, tf)

    def _grow(self, shared: np.ndarray) -> None:
        """Splits ranges where neighbours share least; what is small, or all alike, becomes a leaf, small neighbours together."""
        lo, hi, parent, depth, leaf = [0], [len(self.ids)], [-1], [0], [False]
        at = 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            inner = shared[a + 1 : b]
            if b - a <= LEAF or (least := int(inner.min())) == 4 * int(self.sizes[a:b].max()):
                leaf[at] = True
            else:
                edges = [a, *(np.flatnonzero(inner == least) + a + 1).tolist(), b]
                start = a
                for i in range(1, len(edges)):
                    # A branch is closed when it, or it with the next, would outgrow a leaf.
                    if i == len(edges) - 1 or edges[i + 1] - start > LEAF:
                        if start > a or edges[i] < b:
                            for k, v in ((lo, start), (hi, edges[i]), (parent, at), (depth, depth[at] + 1), (leaf, False)):
                                k.append(v)
                        else:
                            leaf[at] = True
                        start = edges[i]
            at += 1
        self.lo, self.hi, self.leaf, self.parent, self.depth = lo, hi, leaf, np.array(parent), np.array(depth)
        self.children: list[list[int]] = [[] for _ in lo]
        for v, p in enumerate(parent):
            if p >= 0:
                self.children[p].append(v)

    def _bound(self, doc: np.ndarray, tf: np.ndarray) -> None:
        """Greatest tf by (node, term) from the leaves up, least m and id by node; kept by term."""
        is_leaf = np.array(self.leaf)
        owner = np.zeros(len(self.ids), np.int64)
        for v in np.flatnonzero(is_leaf).tolist():
            owner[self.lo[v] : self.hi[v]] = v
        wide = int(self.terms.max()) + 1 if len(self.terms) else 1
        key, most = _greatest(owner[doc] * wide + self.terms, tf)
        keys, mosts = [], []
        at_leaf = self.depth[key // wide] if len(key) else key
        below_key, below_most = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d in range(int(self.depth.max()), -1, -1):
            here = at_leaf == d
            level_key, level_most = np.concatenate((key[here], below_key)), np.concatenate((most[here], below_most))
            keys.append(level_key)
            mosts.append(level_most)
            if d:
                below_key, below_most = _greatest(self.parent[level_key // wide] * wide + level_key % wide, level_most)
        key, most = np.concatenate(keys), np.concatenate(mosts)
        node, term = key // wide, key % wide
        least_m = np.array([self.m[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.least_id = [int(self.ids[a:b].min()) for a, b in zip(self.lo, self.hi)]
        by_term = np.argsort(term, kind="stable")
        self.bound_node = node[by_term]
        self.bound_part = _part(most[by_term], least_m[self.bound_node])
        self.by_term = np.searchsorted(term[by_term], np.arange(wide + 1))
        self.wide = wide

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list, k: int) -> None:
        """Updates ``best``, a heap of (score, -id), with the documents of this tree. ``dense`` holds the item's weights by term."""
        mine = [(self.by_term[t], self.by_term[t + 1], w) for t, w in zip(terms.tolist(), weights.tolist()) if t < self.wide]
        mine = [x for x in mine if x[0] < x[1]]
        if not mine:
            return
        nodes = np.concatenate([self.bound_node[a:b] for a, b, _ in mine])
        parts = np.concatenate([self.bound_part[a:b] * w for a, b, w in mine])
        # Sums stay far below 2 ** 53, so that doubles are exact.
        bounds = np.bincount(nodes, parts, len(self.lo)).astype(np.int64).tolist()
        stack = [0]
        while stack:
            v = stack.pop()
            if not _may_enter(bounds[v], self.least_id[v], best, k):
                continue
            if not self.leaf[v]:
                stack += sorted((c for c in self.children[v] if bounds[c] > 0), key=bounds.__getitem__)
                continue
            a, b = self.lo[v], self.hi[v]
            s, e = int(self.starts[a]), int(self.ends[b - 1])
            sums = np.add.reduceat(dense[self.terms[s:e]] * self.parts[s:e], self.starts[a:b] - s)
            for i in np.flatnonzero(sums > 0).tolist():
                score, doc = int(sums[i]), int(self.ids[a + i])
                if _may_enter(score, doc, best, k):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -doc))


def _may_enter(score: int, doc: int, best: list, k: int) -> bool:
    return score > 0 and (len(best) < k or (score, -doc) > best[0])


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score: grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two sequences share at their start, in whole terms."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint32, n // 4), np.frombuffer(b, np.uint32, n // 4)
    return 4 * int((x != y).argmax())


def _greatest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key.astype(np.int64), value.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.maximum.reduceat(value.astype(np.int64), first)


def restricted(docs: DataFrame, words: list[bytes], doc_id: str, text: str) -> DataFrame:
    """Each document with its number of terms and, of the given words, places and tf."""
    vocabulary = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        for batch in steps(batches):
            n, terms, tfs = [], [], []
            for raw in text_bytes(batch.column("text")):
                found = terms_of(raw)
                held = [(place[w], c) for w, c in Counter(found).items() if w in place]
                n.append(len(found))
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"]
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tokenize, "id long, n long, terms array<int>, tfs array<long>")


def best_of_block(vectors: DataFrame, items: list[tuple[int, list[int]]], df: list[int], count: int, length: int, k: int) -> DataFrame:
    """The k best documents per item and task: item, id (null as it was), score. ``items``: (number, places of its terms)."""
    rank = np.empty(len(df), np.int64)
    rank[sorted(range(len(df)), key=lambda t: (-df[t], t))] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df], np.int64)
    asked = [(no, rank[np.array(t, np.int64)], weight[np.array(t, np.int64)]) for no, t in items if t]
    shipped = vectors.sparkSession.sparkContext.broadcast((rank, asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, asked = shipped.value
        dense = np.zeros(len(rank), np.int64)
        best: dict[int, list] = {no: [] for no, _, _ in asked}
        for ids, n, sizes, terms, tfs in _trees(batches):
            terms = rank[terms]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((terms, doc))
            m = 100 - 90 + (90 * n * count) // length
            tree = Tree(ids, m, sizes, terms[order], tfs[order])
            for no, t, w in asked:
                dense[t] = w
                tree.search(t, w, dense, best[no], k)
                dense[t] = 0
        rows = [(no, None if -doc == NO_ID else -doc, score) for no, heap in best.items() for score, doc in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["item", "id", "score"])

    return vectors.where(F.size("terms") > 0).mapInArrow(search, "item long, id long, score long")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents of all batches in parts of at most ``TREE`` entries: ids, n, sizes, terms, tfs."""
    held: list[tuple[np.ndarray, ...]] = []
    total = 0
    for batch in batches:
        lists, tf_lists = batch.column("terms"), batch.column("tfs")
        ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        ends = np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()
        sizes = np.diff(ends, prepend=0)
        terms, tfs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tf_lists.flatten().to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):
            base = int(ends[at] - sizes[at])
            stop = max(at + 1, int(np.searchsorted(ends - base, TREE - total, side="right")))
            if total and total + int(ends[stop - 1]) - base > TREE:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, total = [], 0
                continue
            held.append((ids[at:stop], n[at:stop], sizes[at:stop], terms[base : ends[stop - 1]], tfs[base : ends[stop - 1]]))
            total += int(ends[stop - 1]) - base
            at = stop
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row per item id: its distinct terms, in order."""
    folded = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    one = items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(F.array_distinct(words)).alias("term"))
    return one.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    asked = item_terms(items, item_id, text).withColumn("n_terms", F.size("terms").cast("long"))
    asked = materialize(prefix_sums(asked, ["item_id"], "n_terms").select("item_id", "terms", F.col("place").cast("long").alias("no"), F.expr(f"before DIV {block}").alias("block")), "fp-items")
    found: DataFrame | None = None
    for b in [r["block"] for r in asked.select("block").distinct().orderBy("block").toLocalIterator()]:
        rows = [(r["no"], [t.encode() for t in r["terms"]]) for r in asked.where(F.col("block") == b).collect()]
        words = sorted({w for _, terms in rows for w in terms})
        place = {w: i for i, w in enumerate(words)}
        vectors = materialize(restricted(docs, words, doc_id, text), "fp-vectors")
        totals = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = [0] * len(words)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
            df[r["term"]] = r["n"]
        if not totals[0]:
            drop_table(vectors)
            break
        best = best_of_block(vectors, [(no, [place[w] for w in terms]) for no, terms in rows], df, int(totals[0]), int(totals[1]), k)
        best = materialize(best, "fp-best")
        drop_table(vectors)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, id long, score long")
    order = (F.col("score").desc(), F.col("id").asc_nulls_last())
    some = F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(SALT))).orderBy(*order))
    found = found.withColumn("rank", some).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    named = found.join(asked.select("item_id", F.col("no").alias("item")), "item")
    return named.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
words AS (SELECT DISTINCT term FROM asked),
held AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) x WHERE term IN (SELECT term FROM words) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term) d, total),
scored AS (
  SELECT a.item_id, h.r, CAST(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (100 - 90 + ((90 * s.n * t.nn) // t.ll))))) AS BIGINT) AS score
  FROM asked a JOIN held h USING (term) JOIN weight w USING (term) JOIN sized s ON s.r = h.r, total t GROUP BY a.item_id, h.r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
