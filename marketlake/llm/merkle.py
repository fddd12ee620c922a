"""Operator 12, Merkle dataset manifest: a tree of SHA-256 states.

Each row is a leaf; the leaves of a tree (here: of a lang) ascend by key, and every two consecutive nodes become their parent until one is left, the
subroot. Subroots, ordered by tree, give the root in the same way. A parent retains a copy of the hash state before each of its
child slots, so that folding a replaced child resumes the state of its slot and adds the replacement and the siblings to its right only.

Leaves are hashed where their texts are read (JVM), numbered by ranges, and dealt in aligned chunks of ``CHUNK`` leaves: a chunk is a
complete subtree of ``LEVELS`` levels and the unit of a task's work. Chunk roots are the leaves of the next round, a ``CHUNK``th as many, until each tree has one node. Then
paths go down: each chunk gets its siblings above once, its states there are prepared once, and all its leaves are folded through them.
Nothing is gathered but single chunks, and the driver sees the root alone.

Defined results: null fields are ``-``; null texts, empty and long texts are fields like others; rows without an id come first in their tree, rows
that repeat an id follow each other by leaf and each have a proof; a row without an id is never tampered with; a null ``n_chars`` stays null, so
that such a row verifies; extra columns take no part and stay out of the result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, read

LEVELS = 12
CHUNK = 1 << LEVELS
#: A step of a path: the sibling's digest, and whether it stands on the left (1), on the right (0) or is lacking (-1).
PATH = "array<struct<side:int,digest:string>>"
LONE, RIGHT, LEFT = -1, 0, 1


class Parent:
    """A node with the digests of its children and the hash state before each child's slot."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[str]) -> None:
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        """This node's digest with another child in ``slot``: the retained state, the replacement and what stands to its right."""
        state = self.states[slot].copy()
        state.update(replacement.encode())
        for sibling in self.children[slot + 1 :]:
            state.update(sibling.encode())
        return state.hexdigest()

    def step(self, slot: int) -> tuple[int, str]:
        if len(self.children) == 1:
            return LONE, ""
        return (RIGHT, self.children[1]) if slot == 0 else (LEFT, self.children[0])


def subtree(digests: list[str], size: int) -> tuple[list[list[Parent]], str]:
    """The parents of a chunk by level, and its root. ``size``: nodes of the whole tree at this level, one chunk ends where one node is left."""
    levels, nodes = [], digests
    for _ in range(LEVELS):
        if size <= CHUNK and len(nodes) == 1:
            break
        parents = [Parent(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(parents)
        nodes = [p.digest for p in parents]
    return levels, nodes[0]


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _chunk_root(table: pa.Table) -> pa.Table:
    table = _ordered(table)
    size = table["size"][0].as_py()
    root = subtree(table["digest"].to_pylist(), size)[1]
    return pa.table({"tree": table["tree"].slice(0, 1), "pos": table["chunk"].slice(0, 1), "size": pa.array([-(-size // CHUNK)], pa.int64()), "digest": [root]})


def _chunk_paths(table: pa.Table) -> pa.Table:
    table = _ordered(table)
    levels, _ = subtree(table["digest"].to_pylist(), table["size"][0].as_py())
    steps = [[dict(zip(("side", "digest"), parents[i >> d >> 1].step(i >> d & 1))) for d, parents in enumerate(levels)] for i in range(len(table))]
    kind = pa.list_(pa.struct([("side", pa.int32()), ("digest", pa.string())]))
    return pa.table({"tree": table["tree"], "pos": table["pos"], "chunk": table["chunk"], "path": pa.array(steps, kind)})


def _fold_chunk(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Folds each leaf of a chunk, tampered where it is, up to the root."""
    leaves = _ordered(leaves)
    digests = leaves["digest"].to_pylist()
    levels, _ = subtree(digests, leaves["size"][0].as_py())
    upper = [(s["side"], s["digest"]) for s in above["path"][0].as_py()]
    # Above the chunk all leaves pass the same slots: one state each, prepared once.
    states = [(hashlib.sha256(d.encode() if side == LEFT else b""), d.encode() if side == RIGHT else b"") for side, d in upper]
    tail = "".join(d for _, d in upper).encode()
    folded, proofs = [], []
    for i, (leaf, tampered) in enumerate(zip(digests, leaves["tampered"].to_pylist())):
        x, proof = tampered or leaf, hashlib.sha256()
        for d, parents in enumerate(levels):
            parent, slot = parents[i >> d >> 1], i >> d & 1
            proof.update(parent.step(slot)[1].encode())
            x = parent.fold(slot, x)
        for state, right in states:
            state = state.copy()
            state.update(x.encode())
            state.update(right)
            x = state.hexdigest()
        proof.update(tail)
        folded.append(x)
        proofs.append(proof.hexdigest())
    n = len(digests)
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    return pa.table({
        "key": leaves["key"], "leaf": digests, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded],
    })


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (0, 1, ... within ``tree`` by ``order``) and ``size`` (rows of the tree).

    Rows are dealt by ranges of (tree, order); counts per range and tree give each range its offset, so that a tree that holds most rows is
    spread over many tasks. ``tree`` has no nulls.
    """
    dealt = materialize(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    totals = dealt.groupBy("part", "tree").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", "tree", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    within = Window.partitionBy("part", "tree").orderBy(*order)
    placed = dealt.withColumn("pos", F.row_number().over(within) - 1).join(offsets, ["part", "tree"])
    out = materialize(placed.withColumn("pos", F.col("pos") + F.col("offset")).drop("part", "offset"), "merkle-numbered")
    drop_table(dealt)
    return out


def _chunked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("chunk", F.shiftright("pos", LEVELS))


def chunk_roots(nodes: DataFrame) -> DataFrame:
    narrow = _chunked(nodes).select("tree", "pos", "size", "digest", "chunk")
    return materialize(narrow.groupBy("tree", "chunk").applyInArrow(_chunk_root, "tree string, pos long, size long, digest string"), "merkle-level")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of chunk roots, from ``nodes`` up; a tree ends at the round in which its size is 1."""
    levels = [nodes]
    while not (more := levels[-1].where("size > 1")).isEmpty():
        levels.append(chunk_roots(more))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The one node that is left of each tree."""
    out = levels[0].where("size = 1").select("tree", "digest")
    for level in levels[1:]:
        out = out.unionByName(level.where("size = 1").select("tree", "digest"))
    return out


def paths(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The path (siblings, level by level) from each node of the lowest round to the top of its tree, and on by ``above`` (tree, path)."""
    found: DataFrame | None = None
    for level in reversed(levels):
        done = level.where("size = 1").select("tree", "pos")
        done = done.withColumn("path", F.array().cast(PATH)) if above is None else done.join(above, "tree").select("tree", "pos", "path")
        if found is not None:
            inner = _chunked(level.where("size > 1")).select("tree", "pos", "size", "digest", "chunk").groupBy("tree", "chunk").applyInArrow(_chunk_paths, f"tree string, pos long, chunk long, path {PATH}")
            up = found.select("tree", F.col("pos").alias("chunk"), F.col("path").alias("up"))
            done = done.unionByName(inner.join(up, ["tree", "chunk"]).select("tree", "pos", F.concat("path", "up").alias("path")))
        found = done
    return found


def field(value: Column) -> Column:
    """One input of a leaf: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def manifest(rows: DataFrame, key: str, tree: str, fields: list[str], tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves hash ``fields``; where ``when`` holds, the folded leaf has the values of ``tampered`` in their place.
    """
    plain = [F.col(f"`{c}`") for c in fields]
    changed = [(tampered or {}).get(c, v) for c, v in zip(fields, plain)]
    fold_other = F.lit(False) if when is None else F.coalesce(when, F.lit(False))
    # Trees without a name sort first and join like others: "" for null, "+" before any name.
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree}`")), F.lit(""))
    hashed = rows.select(
        name.alias("tree"), F.col(f"`{key}`").alias("key"), leaf(plain).alias("digest"), F.when(fold_other, leaf(changed)).alias("tampered"), F.monotonically_increasing_id().alias("row")
    )
    hashed = materialize(hashed, "merkle-leaves")
    leaves = numbered(hashed, ["key", "digest", "row"])
    levels = climb(chunk_roots(leaves))
    subroots = materialize(tops(levels), "merkle-subroots")
    forest = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    forest_levels = climb(forest)
    top = tops(forest_levels).first()
    root = top["digest"] if top else ""
    over = paths(forest_levels, None).join(forest.select("tree", "pos", "name"), ["tree", "pos"]).select(F.col("name").alias("tree"), "path")
    above = paths(levels, over).join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").select("tree", F.col("pos").alias("chunk"), "path", "subroot", F.lit(root).alias("root"))
    above = materialize(above, "merkle-above")
    key_type = rows.schema[key].dataType.simpleString()
    out = (
        _chunked(leaves.select("tree", "pos", "size", "key", "digest", "tampered"))
        .groupBy("tree", "chunk")
        .cogroup(above.groupBy("tree", "chunk"))
        .applyInArrow(_fold_chunk, f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    )
    for done in (hashed, *levels, *forest_levels, subroots):
        drop_table(done)
    return out.withColumnRenamed("key", key)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return manifest(docs, "doc_id", "lang", FIELDS, more, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)

_BYTES = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS UBIGINT))"
#: Unsigned crc32 of a decimal text: bytes one after another, eight steps each.
_CRC = (
    "CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], " + _BYTES + "), lambda a, b: "
    "list_reduce([xor(a, b), 0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT) AS BIGINT)"
)
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_TAMPERED = _LEAF.replace("CAST(n_chars AS", "CAST(n_chars + 1 AS")
OP12_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_TAMPERED} ELSE {_LEAF} END AS x FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r FROM hashed),
nodes AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
forest AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY lvl, pos // 2, n),
fold AS (
  SELECT r, lang, 0 AS lvl, pos, n, x, '' AS proof FROM leaves
  UNION ALL
  SELECT f.r, f.lang, f.lvl + 1, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.x ELSE f.x || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM fold f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
over AS (
  SELECT f.r, 0 AS lvl, t.pos, t.n, f.x, f.proof FROM fold f JOIN subroots t ON t.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT o.r, o.lvl + 1, o.pos // 2, (o.n + 1) // 2,
    sha256(CASE WHEN o.pos % 2 = 1 THEN s.h || o.x ELSE o.x || coalesce(s.h, '') END), o.proof || coalesce(s.h, '')
  FROM over o LEFT JOIN forest s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1) WHERE o.n > 1)
SELECT l.doc_id, l.leaf, t.subroot, g.h AS root, sha256(o.proof) AS proof_sha256, o.x AS folded_root, o.x = g.h AS verified
FROM over o JOIN leaves l USING (r) JOIN subroots t ON t.lang IS NOT DISTINCT FROM l.lang, (SELECT h FROM forest WHERE n = 1) g WHERE o.n = 1
"""
