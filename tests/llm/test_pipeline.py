"""The pipeline on a small table: each stage's decision takes effect."""

import random

from pyspark.sql import functions as F


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    clean = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200)))
    rows = [(i, clean(), "en", f"s{i % 3}") for i in range(150)]
    rows += [(1000 + i, " ".join(f"w{rnd.randrange(50)}$$$" for _ in range(90)), "en", "s0") for i in range(50)]
    rows += [(2000, rows[5][1], "en", "s1"), (2001, rows[6][1] + " end", "en", "s1"), (2002, clean() + " token=abcdef0123456789", "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.when(F.col("text").contains("$$$"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    kept, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        sizes[name] = kept.select("doc_id").distinct().count()
        if name == "quality":
            assert not kept.where("text LIKE '%$$$%'").count() and sizes[name] >= 150
        if name == "near_dedup":
            assert not kept.where("doc_id IN (2000, 2001)").count() and sizes[name] >= sizes["quality"] - 2
        if name == "secrets":
            assert kept.where("text LIKE '%[SECRET]%'").count() == 1 and not kept.where("text LIKE '%abcdef0123456789%'").count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == sizes["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
