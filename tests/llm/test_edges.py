"""Every stage and operator over nulls, empties, a long text, ties, repeated rows, an empty table and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

from marketlake.llm import chat, media, mixing, near_dedup, packing, quality, secret_scan, sharding, substring_dedup, topk
from marketlake.llm.common import new_table

#: Names that the operators use inside; each is an extra column of the table.
CLASHING = (
    "_id", "_th", "_no", "_source", "_doc", "_copies", "_n", "_at", "row", "stat", "label", "score", "col", "blob", "spans", "node", "key", "n", "first", "alone", "th", "size", "copies", "ids", "uid",
    "k0", "part", "_part", "_rows", "_bytes", "place", "shard", "kept", "digest", "quality", "held_out", "media", "m", "tree", "parent", "depth", "total", "q", "id", "rank", "source_size", "target", "picked", "_stat_" + quality.FEATURES[0],
)
RND = random.Random(3)
CLEAN = [" ".join(f"w{RND.randrange(3000)}" for _ in range(RND.randrange(30, 60))) for _ in range(12)]
LONG = " ".join(f"l{RND.randrange(90000)}" for _ in range(120_000))
ROWS = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(CLEAN)]
ROWS += [(20, None, "en", "s0"), (21, "", "en", "s0"), (22, " \t ", None, None), (23, LONG, "en", "s1"), (24, CLEAN[0], "en", "s1"), (24, CLEAN[0], "en", "s1"), (None, CLEAN[1], "en", "s2"), (None, CLEAN[1], "en", "s2")]
ROWS += [(None, CLEAN[2] + " x", None, None), (25, CLEAN[3] + " token=abcdef0123456789", "en", "s1"), (26, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return plain.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


STAGES = {"quality": quality.stage_quality, "near_dedup": near_dedup.stage_near_dedup, "secrets": secret_scan.stage_redact, "mixing": mixing.stage_mix}


def rows_of(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, docs, folder, name):
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns
    assert all(out.where(f"`{c}` IS NULL OR `{c}` != 'own {c}'").isEmpty() for c in ("_id", "label", "col", "row", "blob", "_th", "spans", "score"))
    got = rows_of(out)
    every = sorted((i is not None, i or 0, t is not None, t or "") for i, t, _, _ in ROWS)
    if name == "quality":
        assert got == every
    if name == "near_dedup":
        # One of each group of copies stays, the one of least doc_id; rows without words all stay.
        gone = [(True, 24, True, CLEAN[0])] * 2 + [(False, 0, True, CLEAN[1])] * 2 + [(False, 0, True, CLEAN[2] + " x"), (True, 25, True, ROWS[-2][1])]
        assert got == sorted(x for x in every if x not in gone)
    if name == "secrets":
        assert len(got) == len(every) and sum("[SECRET]" in x[3] for x in got) == 1
        assert out.where("text IS NULL AND n_chars IS NOT NULL OR length(text) != n_chars").isEmpty()
    if name == "mixing":
        mixed = mixing.mix(docs).agg(F.sum("copies")).first()[0]
        assert abs(len(got) - mixed) <= 6 and set(got) <= set(every)
    empty = STAGES[name](spark, docs.where("false"), folder)
    assert empty.columns == docs.columns and empty.isEmpty()


def test_last_stage(spark, docs, folder):
    out = packing.stage_pack(spark, docs, folder)
    assert out.where("start = 0").count() == len(ROWS)
    assert packing.stage_pack(spark, docs.where("false"), folder).isEmpty()


def test_near_dedup_keeps_one_of_copies_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    assert sorted(r["text"] for r in near_dedup.stage_near_dedup(spark, docs, "").collect()) == ["a b c d e f", "g h i j k l"]


def test_operators_take_clashing_columns(spark, docs):
    assert near_dedup.near_duplicates(docs).count() == len(ROWS)
    assert substring_dedup.dedup_substrings(docs).count() == len(ROWS)
    assert mixing.mix(docs).count() == len(ROWS)
    assert packing.pack(docs).where("start = 0").count() == len(ROWS)
    assert secret_scan.scan_history(docs, new_table(spark, "ledger")).count() == len(ROWS)
    assert media.clip_rows(media.with_media(docs, "text"), keep=("doc_id",)).select("doc_id").count() >= len(ROWS)
    sized = docs.withColumn("bytes", F.lit(1).cast("long"))
    out = sharding.byte_shards(sized, ["doc_id"], "bytes")
    assert out.count() == len(ROWS) and set(out.columns) == {*sized.columns, "slot"} and out.where("place != 'own place' OR total != 'own total' OR part != 'own part'").isEmpty()
    assert sharding.byte_shards(sized.where("false"), ["doc_id"], "bytes").isEmpty()
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"))
    assert quality.score(docs, model).where("score BETWEEN 0 AND 1").count() == len(ROWS)
    vectors = docs.select("*", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.col("doc_id").alias("vec_id"))
    q = topk.quantized(vectors, "vec_id", "embedding", 256)
    assert topk.top_k(q.where("id = 20"), q, 5).count() == 5
    talk = docs.select(*(c for c in docs.columns if c not in ("tree", "node", "parent", "score")), F.col("source").alias("tree"), F.coalesce("doc_id", F.lit(99)).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(1.0).alias("score"), F.lit("user").alias("role"))
    chats = chat.format_paths(chat.best_paths(talk), talk)
    assert chats.count() == 4


def test_mixing_takes_rows_apart_that_differ_in_a_map(spark, folder):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b c d' AS text, 'en' AS lang, 's' AS source, 7L AS n_chars, map('k', v) AS m FROM VALUES (1), (2) t(v)")
    out = mixing.stage_mix(spark, docs, folder).select(F.col("m")["k"].alias("k")).collect()
    assert {r["k"] for r in out} == {1, 2} and len(out) == 3


def test_mixing_deals_repeats_to_many_groups(spark):
    """One row many times: each repeat is a unit of its own, totals are near the target, and reruns agree."""
    rows = [(1, "a b c", "s")] * 20_000 + [(i, "w " * (i % 9 + 1), "t" if i % 2 else "s") for i in range(2, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select("source", "doc_id", F.lit(0).cast("long").alias("th"), F.lit(3).cast("long").alias("size"))
    numbered = mixing.numbered_repeats(sized.where("doc_id = 1"))
    assert numbered.count() == 20_000 == numbered.select("again").distinct().count()
    runs = [sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "copies", "target", "source").collect()), key=str) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    for source in "st":
        mine = [r for r in runs[0] if r[4] == source]
        assert abs(sum(r[1] * r[2] for r in mine) - mine[0][3]) <= 9 and all(r[2] <= 2 for r in mine)
