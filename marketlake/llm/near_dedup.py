"""Operator 5, MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star edges.

A document's set holds its distinct word shingles (A-Z lower-cased). One hash per shingle falls into one of
bands x rows bins; a bin's least hash is its sample and an empty bin copies the sample of the bin that a shared probe
sequence finds first. Documents of equal sets are one node. In each band's bucket the least node is the centre of a
star: one candidate edge per member, so that pairs grow with members, not with their square. Edges are confirmed on
full sets, and the links give labels (components).

A bucket whose members then still have several labels is mixed: a member may be linked to another one and not to the
centre. Its members outside the bucket's largest component are compared with all of it, in blocks of ``BLOCK`` members
that carry samples (and the sets of up to ``SMALL`` shingles). A block pair gives only the pairs that pass, each in the
first band that it shares. No pair is a row, no bucket is capped and no further rounds follow. This work is members times those
outside the largest component: a family whose members are just below the limit to each other costs its square in comparisons.

At a similarity of 0.8, 42 bands of 6 rows miss a pair with probability 3e-6. A comparison of samples comes first where it can
tell: pairs whose samples agree less than ``DEVIATIONS`` standard deviations below the limit are not read in full, the deviation
being that of the bins that sets of this size fill. Sets below ``SIEVED`` shingles are always compared in full.

Defined results: a null or empty text has an empty set (0 shingles) and stays alone; a null doc_id counts as the largest;
rows that repeat a doc_id are all kept or all not; extra columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, batches_of, drop_table, materialize, mix, read, small_batches, steps, text_bytes

BANDS, ROWS, PROBES = 42, 6, 2000
NO_ID = (1 << 63) - 1
BLOCK, SMALL = 256, 256
#: Blocks of a bucket that one group of comparisons takes at most; comparisons and members that make a task, and tasks at most.
GROUP, COMPARED, MEMBERS, MOST_TASKS = 8, 64 * BLOCK * BLOCK, 20_000, 20_000
SIEVED, DEVIATIONS = 40, 5.5
#: Full bins up to which a set's empty bins look up the probe that meets each full one, instead of going through the probes.
FEW = 64
_SIGNATURE = "_id long, _th long, n int, digest binary, keys array<long>, sample binary, folded binary, small binary"


def shingle_sets(texts: list[bytes], k: int, cache: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = cache.of([w for doc in split for w in doc])
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            rolled = mix(rolled * np.uint64(31) + words[j : j + n] + np.uint64(j + 1))
    ends, out = np.cumsum(sizes), []
    for size, end in zip(sizes.tolist(), ends.tolist()):
        if size >= k:
            out.append(np.unique(rolled[end - size : end - k + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[end - size : end].tobytes(), size)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def first_probes(probes: np.ndarray) -> np.ndarray:
    """Bins x bins: for a full bin and an empty one, the first probe of the empty bin that meets the full one (their number if none does)."""
    n, bins = probes.shape
    first, empty = np.full((bins, bins), n, np.int32), np.arange(bins)
    for p in range(n - 1, -1, -1):
        first[probes[p], empty] = p
    return first


def one_permutation(sets: list[np.ndarray], bins: int, probes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents x bins: the least hash of each bin, empty bins filled along the shared probe sequence (``first`` is its ``first_probes``)."""
    bounds = np.array([(j << 64) // bins for j in range(bins)], np.uint64)
    upper = np.append(bounds[1:] - np.uint64(1), np.uint64((1 << 64) - 1))
    values = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.minimum(np.searchsorted(s, bounds), len(s) - 1)
            v = s[at]
            full[i] = (v >= bounds) & (v <= upper)
            values[i] = np.where(full[i], v, s[0])
    filled = full.sum(axis=1)
    for i in np.flatnonzero((filled > 1) & (filled <= FEW)):
        held = np.flatnonzero(full[i])
        at = first[held]
        nearest = at.argmin(axis=0)
        met = ~full[i] & (at[nearest, np.arange(bins)] < len(probes))
        values[i] = np.where(met, values[i][held[nearest]], values[i])
    rows = np.flatnonzero((filled > FEW) & (filled < bins))
    empty, source = ~full[rows], full[rows]
    held = values[rows]
    sampled = held.copy()
    live = np.arange(len(rows))
    for p in probes:
        fill = empty[live] & source[live][:, p]
        sampled[live] = np.where(fill, held[live][:, p], sampled[live])
        empty[live] &= ~fill
        live = live[empty[live].any(axis=1)]
        if not len(live):
            break
    values[rows] = sampled
    return values


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bins = WordHashes(), bands * rows
        with np.errstate(over="ignore"):
            probes = (mix(np.arange(PROBES * bins, dtype=np.uint64) + np.uint64(1 << 40)) % np.uint64(bins)).astype(np.int64).reshape(PROBES, bins)
            first = first_probes(probes)
            for batch in steps(batches):
                sets = shingle_sets(text_bytes(batch.column("text")), k, cache)
                values = one_permutation(sets, bins, probes, first)
                low = (values & np.uint64(255)).astype(np.uint8)
                values = values.reshape(len(sets), bands, rows)
                key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(7)), (len(sets), bands))
                for r in range(rows):
                    key = mix(key * np.uint64(31) + values[:, :, r])
                sizes = np.array([len(s) for s in sets], np.int32)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                some = sizes > 0
                offsets = np.append(0, np.cumsum(some * bands)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some].ravel().view(np.int64)))
                folded = [r.tobytes() for r in key.astype(np.uint32)]
                small = [s.astype(np.uint32).tobytes() if len(s) <= SMALL else b"" for s in sets]
                columns = [batch.column("_id"), batch.column("_th"), pa.array(sizes), pa.array(digests, pa.binary()), keys, *(pa.array(x, pa.binary()) for x in ([r.tobytes() for r in low], folded, small))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_th", "n", "digest", "keys", "sample", "folded", "small"])

    return run


def least_agreeing(n: np.ndarray, bins: int, percent: int) -> np.ndarray:
    """Bins that must agree for a pair whose smaller set has n shingles to be read in full; 0 where samples cannot tell."""
    filled, share = bins * -np.expm1(-n / bins), percent / 100
    least = bins * (share - DEVIATIONS * np.sqrt(share * (1 - share) / np.maximum(filled, 1)))
    return np.where(n < SIEVED, 0, np.maximum(least, 0))


def _agreeing(bins: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, bins) for c in ("a_sample", "b_sample"))
            n = np.minimum(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least_agreeing(n, bins, percent)))

    return run


class Block:
    """Members of a bucket as arrays."""

    def __init__(self, members: pa.StructArray, bins: int) -> None:
        self.node, self.label, self.n = (members.field(c).to_numpy() for c in ("node", "label", "n"))
        raw = lambda c, t: np.frombuffer(b"".join(members.field(c).to_pylist()), t)
        self.sample, self.folded = raw("sample", np.uint8).reshape(-1, bins), raw("folded", np.uint32).reshape(len(self.n), -1)
        self.small = raw("small", np.uint32)
        self.end = np.cumsum(np.where(self.n <= SMALL, self.n, 0))

    def small_set(self, i: int) -> np.ndarray:
        return self.small[self.end[i] - self.n[i] : self.end[i]]

    def shared(self, s: np.ndarray, places: np.ndarray) -> np.ndarray:
        """At least the number of shingles that the small sets at ``places`` share with ``s`` (32 bits of each are compared)."""
        n = self.n[places]
        ends = np.cumsum(n)
        flat = self.small[np.repeat(self.end[places] - ends, n) + np.arange(ends[-1])]
        s = np.sort(s)
        hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
        return np.add.reduceat(hit, ends - n, dtype=np.int64)


def _across(bins: int, percent: int):
    """Per pair of blocks, the pairs of unlike labels that may be similar and share no earlier band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            sides = [batch.column(c) for c in ("some", "all")]
            for row, band in enumerate(batch.column("band").to_pylist()):
                some, every = (Block(x.values.slice(x.offsets[row].as_py(), len(x[row])), bins) for x in sides)
                for i in range(len(some.n)):
                    less, more = np.minimum(some.n[i], every.n), np.maximum(some.n[i], every.n)
                    j = np.flatnonzero((every.label != some.label[i]) & (100 * less >= percent * more))
                    j = j[(every.sample[j] == some.sample[i]).sum(axis=1) >= least_agreeing(less[j], bins, percent)]
                    if len(j):
                        j = j[(every.folded[j] == some.folded[i]).argmax(axis=1) == band]
                    both_small = (every.n[j] <= SMALL) & (some.n[i] <= SMALL)
                    if both_small.any():
                        at = j[both_small]
                        shared = every.shared(some.small_set(i), at)
                        j = np.append(j[~both_small], at[100 * shared >= percent * (some.n[i] + every.n[at] - shared)])
                    if len(j):
                        found.append((np.minimum(some.node[i], every.node[j]), np.maximum(some.node[i], every.node[j])))
            a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in steps(batches, "b_text"):
            b = shingle_sets(text_bytes(batch.column("b_text")), k, cache)
            names = batch.column("a").to_numpy()
            head = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
            centres = shingle_sets(text_bytes(batch.column("a_text").take(pa.array(head))), k, cache)
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(names))))
            both = np.array([len(np.intersect1d(centres[c], s, assume_unique=True)) for c, s in zip(of, b)], np.int64)
            sizes = np.array([len(centres[c]) + len(s) for c, s in zip(of, b)], np.int64)
            linked = 100 * both >= percent * (sizes - both)
            yield batch.select(["a", "b"]).filter(pa.array(linked.astype(bool)))

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that edges (a, b) reach. Least labels spread and jump until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        moved = materialize(spread.join(jump, "next").select("node", F.least("next", "jumped").alias("label"), "was"), "labels")
        changed = moved.where("label != was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only the graph of the labels that these join is worked through again."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    lifted = named.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a != b")
    moved = connected(lifted).select(F.col("node").alias("_was"), F.col("label").alias("_now"))
    nodes = labels.unionByName(moved.select(F.col("_was").alias("node"), F.col("_was").alias("label"))).dropDuplicates(["node"])
    return nodes.join(moved, nodes.label == moved._was, "left").select("node", F.coalesce("_now", "label").alias("label"))


def _components(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """_id, _th, n of each row of (_id, _th, text), and the least (_id, _th) of its component as ``first``."""
    bins, spark = bands * rows, docs.sparkSession
    signed = materialize(docs.mapInArrow(_signatures(shingle, bands, rows), _SIGNATURE), "signatures")
    sets = signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("_id", "_th")).alias("rep"), *(F.first(c).alias(c) for c in ("n", "keys", "sample", "folded", "small")))
    nodes = materialize(sets.select("digest", "rep.*", "n", "keys", "sample", "folded", "small", F.monotonically_increasing_id().alias("node")), "nodes")
    members = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    buckets = materialize(members.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("m")).where("m > 1"), "buckets")
    member = materialize(members.join(buckets, "key"), "members")
    stars = member.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), F.col("n").alias("b_n")).distinct()
    stars = stars.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("a_n")), "a").where(_compatible(percent))
    links = materialize(_confirmed(docs, nodes, _alike(nodes, stars, bins, percent), shingle, percent), "confirmed")
    labels = connected(links)
    named = member.where("m > 2").join(labels, "node", "left").select("key", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    named = materialize(named, "named")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m")).where("m > top.c")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = materialize(mixed.select("key", F.col("top.label").alias("largest"), blocks(F.col("m")).alias("every"), blocks(F.col("m") - F.col("top.c")).alias("others"), "m", (F.col("m") - F.col("top.c")).alias("outside")), "mixed")
    if mixed.limit(1).count():
        rest = materialize(named.join(mixed.drop("m", "outside"), "key").join(nodes.select("node", "sample", "folded", "small"), "node"), "rest")
        holds = F.collect_list(F.struct("node", "label", "n", "sample", "folded", "small"))
        dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int").alias("block")
        every = materialize(rest.groupBy("key", dealt("every")).agg(holds.alias("all")), "every")
        some = rest.where("label != largest").groupBy("key", "every", dealt("others")).agg(F.first("band").alias("band"), holds.alias("some")).drop("block")
        some = materialize(some, "some")
        # A hot bucket's blocks meet in many tasks: each block of the one side goes to all groups of the other side's blocks, and tasks are as many as the work asks for.
        groups = F.floor((F.col("every") - 1) / GROUP).cast("int")
        compared, sent = mixed.agg(F.sum(F.col("m").cast("double") * F.col("outside")), F.sum(F.col("m") + F.col("outside") * (groups + 1.0))).first()
        tasks = int(min(max(spark.sparkContext.defaultParallelism, compared // COMPARED, sent // MEMBERS), MOST_TASKS))
        meets = lambda df: df.repartition(tasks, "key", "group")
        left = some.withColumn("group", F.explode(F.sequence(F.lit(0), groups)))
        right = every.select("key", F.floor(F.col("block") / GROUP).cast("int").alias("group"), "all")
        with batches_of(spark, 8):
            pairs = meets(left).join(meets(right), ["key", "group"]).select("band", "some", "all")
            pairs = materialize(pairs.mapInArrow(_across(bins, percent), "a long, b long"), "across")
        for table in (rest, every, some):
            drop_table(table)
        more = materialize(_confirmed(docs, nodes, pairs.distinct(), shingle, percent), "confirmed")
        if more.limit(1).count():
            labels = materialize(_merged(labels, more), "labels")
    for table in (buckets, member, named):
        drop_table(table)
    reached = nodes.join(labels, "node", "left").select("digest", "_id", "_th", F.coalesce("label", "node").alias("label"))
    reached = materialize(reached, "reached")
    least = reached.groupBy("label").agg(F.min(F.struct("_id", "_th")).alias("first"))
    named = reached.join(least, "label").select("digest", "first")
    return signed.select("_id", "_th", "n", "digest").join(named, "digest", "left").select("_id", "_th", "n", F.when(F.col("n") > 0, F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_th"), "text")
    out = _components(docs, shingle, percent, bands, rows)
    component, real = F.coalesce("first._id", "_id"), lambda c: F.when(c != NO_ID, c)
    return out.select(
        real(F.col("_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real(component).alias("component_id"), (F.col("_id") == component).alias("kept")
    )


def _compatible(percent: int):
    return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")


def _alike(nodes: DataFrame, edges: DataFrame, bins: int, percent: int) -> DataFrame:
    """The edges (a, b, a_n, b_n) whose samples agree in enough bins."""
    sample = lambda side: nodes.select(F.col("node").alias(side), F.col("sample").alias(f"{side}_sample"))
    paired = edges.join(sample("a"), "a").join(sample("b"), "b").select("a", "b", "a_n", "b_n", "a_sample", "b_sample")
    return materialize(paired.mapInArrow(_agreeing(bins, percent), "a long, b long"), "alike")


def _confirmed(docs: DataFrame, nodes: DataFrame, edges: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar; only the texts of their nodes are shuffled on."""
    needed = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    needed = nodes.select("node", "_id", "_th").join(needed, "node")
    texts = materialize(docs.join(needed, ["_id", "_th"]).select("node", "text").dropDuplicates(["node"]), "texts")
    pairs = edges.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(_confirm(shingle, percent), "a long, b long")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 1000)
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of five-word shingle sets at least 0.8 similar, one row stays, that of the least doc_id.

    Defined results: all rows of null or empty texts stay; a null doc_id counts as the largest, so that a copy without id
    goes and one of several copies without ids stays; of rows equal in doc_id and text one stays; two rows that share a
    doc_id but not their text are judged each; extra columns stay, whatever their names; an empty table gives no rows.
    """
    small_batches(spark, 1000)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").alias("text"), F.struct("*").alias("row"))
    found = _components(keyed.select("_id", "_th", "text"), 5, 80, BANDS, ROWS)
    stays = materialize(found.where("n = 0 OR first = struct(_id, _th)").select("_id", "_th", "n").distinct(), "stays")
    # Only rows of empty texts may repeat.
    alone = F.when(F.col("n") == 0, F.monotonically_increasing_id())
    left = keyed.drop("text").join(stays, ["_id", "_th"]).withColumn("alone", alone).dropDuplicates(["_id", "_th", "alone"])
    return left.select("row.*")
