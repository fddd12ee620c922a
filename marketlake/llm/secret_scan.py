"""Operator 2, secret scans, native: an incremental ledger of content-addressed blobs.

``scan_history`` takes every version of every path, addresses its content by SHA-256, scans each blob once per
rule version and keeps the spans in a ledger (Parquet). A later run scans only the pairs of blob and rule version
that the ledger lacks, then joins findings back to all paths. All work is DataFrame functions.

Defined results: a null text counts as empty and has no findings; equal texts share one blob; an empty table gives no rows;
extra columns of the input stay, but for columns named blob or spans, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_table, read


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; kept are those whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: A private key from its BEGIN line to the matching END line; without one, to the end of the header fields and base64 lines.
PEM = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END \1PRIVATE KEY-----"
    r"|(?:\s*+[A-Za-z-]++: [^\r\n]*+)*+(?:\s*+[A-Za-z0-9+/]{32,}+={0,2})*+(?:[^\S\n]*+\n[A-Za-z0-9+/]++={0,2}(?![^\r\n]))?)"
)
#: In the order by which spans of equal start are sorted; the first three are the base kinds.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Rule("pem", 2, PEM),
)
BASE = 3
MATCHES = "array<struct<rank:int,gap:int,length:int,gap_bytes:int,bytes:int,kept:boolean>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def matches_of(text: Column, rule: Rule, rank: int) -> Column:
    """The matches of one rule in order: the lengths of each and of the gap before it, in code points and bytes, and whether it is kept."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    measured = F.zip_with(
        found,
        F.slice(gaps, 1, F.size(found)),
        lambda m, g: F.struct(
            F.lit(rank).alias("rank"), F.length(g).alias("gap"), F.length(m).alias("length"), F.octet_length(g).alias("gap_bytes"), F.octet_length(m).alias("bytes"), _kept(m, rule).alias("kept")
        ),
    )
    return F.when(text.rlike(rule.pattern), measured).otherwise(F.array().cast(MATCHES))


def with_spans(blobs: DataFrame, matches: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, scanned and spans (start, rank, end, kind, version, and the bytes from, to) of rows with blob and scanned.

    Offsets are running sums over the exploded matches of a blob and rule. Rows are dealt by blob already, so that nothing is shuffled, and work grows with
    the matches, however many one text has. Texts do not pass the explode.
    """
    one = blobs.select("blob", "scanned", F.posexplode_outer(matches).alias("pos", "m")).select("blob", "scanned", "pos", "m.*")
    run = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(run)).withColumn("to", F.sum(F.col("gap_bytes") + F.col("bytes")).over(run))
    named = lambda value: F.array(*(F.lit(value(r)) for r in rules))[F.col("rank")]
    span = F.struct(
        (F.col("end") - F.col("length")).cast("int").alias("start"), "rank", F.col("end").cast("int").alias("end"), named(lambda r: r.kind).alias("kind"), named(lambda r: r.version).alias("version"),
        (F.col("to") - F.col("bytes")).cast("int").alias("from"), F.col("to").cast("int").alias("to"),
    )
    return one.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.collect_list(F.when(F.col("kept"), span)).alias("spans"))


def _kept(match: Column, rule: Rule) -> Column:
    if not rule.group:
        return F.length(match) >= rule.least
    return F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least


def scan_blobs(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """blob and spans (sorted by start, then rule) of each distinct content, from the ledger, which gains what it lacked.

    Each distinct content crosses the shuffle once per map task at most, since the map side combines equal blobs.
    """
    spark = docs.sparkSession
    known = _ledger(spark, ledger)
    blobs = docs.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    blobs = blobs.groupBy("blob").agg(F.first("content").alias("content"))
    every = F.array(*(F.lit(r.key) for r in rules))
    if known is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        todo = todo.where(F.size(F.array_except(every, F.col("done"))) > 0)
    nothing = F.array().cast(MATCHES)
    matches = F.flatten(F.array(*(F.when(F.array_contains("done", r.key), nothing).otherwise(matches_of(F.col("content"), r, i)) for i, r in enumerate(rules))))
    new = with_spans(todo.withColumn("scanned", F.array_except(every, F.col("done"))), matches, rules)
    new.write.mode("append").parquet(ledger)
    scanned = spark.read.parquet(ledger)
    if known is not None:
        # Writers that met in one ledger may both have scanned a blob: a span counts once.
        scanned = scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    of_rules = F.filter("spans", lambda s: F.array_contains(every, F.concat_ws("@", s["kind"], s["version"])))
    return scanned.select("blob", F.array_sort(of_rules).alias("spans"))


def scan_history(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds ``blob`` and ``spans`` to each row: findings of its content, joined back to every path. Columns of these names are replaced."""
    held = scan_blobs(docs, ledger, rules, text)
    return docs.drop("blob", "spans").withColumn("blob", blob_id(F.col(text))).join(held, "blob")


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else None


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masks(held: DataFrame) -> DataFrame:
    """Per blob with spans, the byte ranges that they cover, overlapping ones as one, in order. Work grows with the spans."""
    one = held.select("blob", F.explode("spans").alias("s")).select("blob", F.col("s.start").alias("start"), F.col("s.from").alias("from"), F.col("s.to").alias("to"))
    before = Window.partitionBy("blob").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("apart", (F.col("from") >= F.coalesce(F.max("to").over(before), F.lit(0))).cast("int"))
    one = one.withColumn("island", F.sum("apart").over(Window.partitionBy("blob").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)))
    merged = one.groupBy("blob", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("masks"))


def redact(text: Column, ranges: Column, mask: str = "[SECRET]") -> Column:
    """The text with each byte range replaced by ``mask``: slices of bytes, joined once."""
    raw = text.cast("binary")
    ends = F.concat(ranges, F.array(F.struct(F.octet_length(text).alias("from"), F.octet_length(text).alias("to"))))
    parts = F.transform(ends, lambda r, i: F.substring(raw, F.when(i > 0, F.get(ranges, i - 1)["to"]).otherwise(0) + 1, r["from"] - F.when(i > 0, F.get(ranges, i - 1)["to"]).otherwise(0)).cast("string"))
    return F.when(F.size(ranges) > 0, F.array_join(parts, mask)).otherwise(text)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_history(docs, new_table(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < BASE)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
    )


def stage_redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are masked in place and ``n_chars`` counted anew; every document stays.

    Defined results: a null text stays null with null ``n_chars``, an empty one empty; repeated rows stay each; overlapping spans
    become one mask; extra columns stay, whatever their names (``blob`` and ``spans`` too); an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    covered = materialize(masks(scan_blobs(rows, new_table(spark, "secret-ledger"))), "secret-masks")
    found = rows.withColumn("blob", blob_id(F.col("text"))).join(covered, "blob", "left")
    clean = found.select("row", F.when(F.col("masks").isNotNull(), redact(F.col("text"), F.col("masks"))).otherwise(F.col("text")).alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
