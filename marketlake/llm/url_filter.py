"""Operator 11, URL filters, native: rules first, gradient-boosted trees on lexical features for the rest.

A list of rules judges the urls that it fits; these are the labelled urls unless the caller brings labels. Trees are boosted on
lexical features (length, depth, digit ratio, entropy, parameter counts, host shape) and on statistics of suffixes (the host's
last label, its last two labels, the path's extension: how often they occur among all urls, and how often they are blocked among the labelled).
Suffixes are hashed to ``BUCKETS`` cells a kind, so that their table has a fixed size and is broadcast: no url is shuffled and a
suffix that holds a third of all rows is no hot key. Each level of a tree is one aggregation of gradients by (node, feature, bin); the
driver sees these histograms only. Sums are of integers, so that reruns agree. The trees become Spark columns; all is DataFrame functions.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees like any other;
equal urls get equal results; rows that repeat stay each; without labels, or with one class, the smoothed share of blocked labels decides
(no labels: allow); an empty table gives no rows; extra columns stay, but for host, path, rule, score and verdict, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, read

#: Cells of each kind of suffix; labelled urls that the trees are fitted on, by expectation; trees, their depth, cuts of a feature, step.
BUCKETS, SAMPLE, TREES, DEPTH, CUTS, RATE = 4096, 20_000, 12, 3, 15, 0.3
#: Gradients are summed as integers of this unit.
UNIT = float(1 << 20)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
SUFFIXES = ("label", "domain", "extension")
FEATURES = (
    "log_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "query_length", "fragment", "host_labels", "hyphens",
    *(f"{s}_count" for s in SUFFIXES), *(f"{s}_blocked" for s in SUFFIXES),
)


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def with_parts(rows: DataFrame) -> DataFrame:
    """Adds host, path and query (what follows the path) to rows with a non-null ``url``."""
    rest = F.when(F.instr("url", "://") > 0, F.col("url").substr(F.instr("url", "://") + 3, F.length("url"))).otherwise(F.lit(""))
    rows = rows.withColumn("_rest", rest)
    rows = rows.withColumn("host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    rows = rows.withColumn("_rest", F.col("_rest").substr(F.length("host") + 1, F.length("_rest")))
    rows = rows.withColumn("path", F.regexp_extract("_rest", r"^[^?#]*", 0))
    rows = rows.withColumn("query", F.col("_rest").substr(F.length("path") + 1, F.length("_rest")))
    return rows.withColumn("host", F.translate("host", UPPER, LOWER)).drop("_rest")


def with_rule(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``rule`` (the longest that fits, or null) and ``ruled`` (its verdict)."""
    longest_first = sorted(rules, key=lambda r: -len(r.name))
    fits = lambda r: r.fits(F.col("host"), F.col("path"))
    none = F.lit(None).cast("string")
    return rows.withColumns({
        "rule": F.coalesce(none, *(F.when(fits(r), F.lit(r.name)) for r in longest_first)),
        "ruled": F.coalesce(none, *(F.when(fits(r), F.lit(r.verdict)) for r in longest_first)),
    })


def entropy(text: Column) -> Column:
    """Bits a character: log2 n - sum(c log2 c) / n over the runs of the sorted characters, in time n log n."""
    plogp = lambda n: n * F.log2(n)
    n = F.length(text).cast("double")
    runs = F.aggregate(
        F.array_sort(F.split(text, "")),
        F.struct(F.lit("").alias("char"), F.lit(1.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.when(x == acc["char"], F.struct(acc["char"].alias("char"), (acc["run"] + 1.0).alias("run"), acc["sum"].alias("sum"))).otherwise(
            F.struct(x.alias("char"), F.lit(1.0).alias("run"), (acc["sum"] + plogp(acc["run"])).alias("sum"))
        ),
        lambda acc: acc["sum"] + plogp(acc["run"]),
    )
    return F.when(n > 0, F.log2(n) - runs / n).otherwise(F.lit(0.0))


def suffix_cells(host: Column, path: Column) -> list[Column]:
    """The cell of each kind of suffix; kinds do not share cells."""
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$|(/)$", 0)
    keys = (F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), extension)
    return [(F.pmod(F.xxhash64(k), F.lit(BUCKETS)) + i * BUCKETS).cast("int") for i, k in enumerate(keys)]


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features as columns."""
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    n = F.length(url)
    count = lambda text, char: F.length(text) - F.length(F.translate(text, char, ""))
    asked = F.regexp_extract(query, r"^\?([^#]*)", 1)
    return rows.withColumns({
        "log_length": F.log1p(n.cast("double")),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/").cast("double"),
        "digit_ratio": F.when(n > 0, (n - F.length(F.translate(url, DIGITS, ""))) / n).otherwise(F.lit(0.0)),
        "entropy": entropy(url),
        "parameters": F.when(asked == "", 0.0).otherwise(count(asked, "&").cast("double") + 1.0),
        "query_length": F.length(asked).cast("double"),
        "fragment": F.when(F.contains(query, F.lit("#")), 1.0).otherwise(0.0),
        "host_labels": count(host, ".").cast("double"),
        "hyphens": count(host, "-").cast("double"),
    })


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """Per cell: log count of urls and smoothed share of blocked ones among the labelled; at most 3 * BUCKETS rows, combined on the map side.

    ``rows`` have host, path and ``label`` (1 block, 0 allow, null unknown).
    """
    cells = rows.select(F.explode(F.array(*suffix_cells(F.col("host"), F.col("path")))).alias("cell"), "label")
    sums = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    return sums.select("cell", F.log1p(F.col("n").cast("double")).alias("log_n"), ((F.col("blocked") + 1) / (F.col("known") + 2)).alias("share"), "n", "known", "blocked")


def with_features(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds all features; ``statistics`` has a fixed greatest size and is broadcast."""
    rows = lexical(rows).withColumns({f"_{s}": c for s, c in zip(SUFFIXES, suffix_cells(F.col("host"), F.col("path")))})
    for s in SUFFIXES:
        of = statistics.select(F.col("cell").alias(f"_{s}"), F.col("log_n").alias(f"{s}_count"), F.col("share").alias(f"{s}_blocked"))
        rows = rows.join(F.broadcast(of), f"_{s}", "left")
    return rows.fillna(0.0, [f"{s}_count" for s in SUFFIXES]).fillna(0.5, [f"{s}_blocked" for s in SUFFIXES])


@dataclass
class Node:
    """A leaf with a step, or a split of one feature at one cut."""

    step: float = 0.0
    feature: int = -1
    cut: int = -1
    low: Node | None = None
    high: Node | None = None

    def column(self, at_most) -> Column:
        """The step as a column; ``at_most(feature, cut)`` tells whether a row goes low."""
        if self.low is None:
            return F.lit(self.step)
        return F.when(at_most(self.feature, self.cut), self.low.column(at_most)).otherwise(self.high.column(at_most))


@dataclass
class Model:
    prior: float
    cuts: list[list[float]] = field(default_factory=list)
    trees: list[Node] = field(default_factory=list)

    def score(self) -> Column:
        """The probability that a row with feature columns is to be blocked."""
        at_most = lambda f, c: F.col(FEATURES[f]) <= self.cuts[f][c]
        margin = reduce(lambda a, b: a + b, (t.column(at_most) for t in self.trees), F.lit(self.prior))
        return 1.0 / (1.0 + F.exp(-margin))


def _cuts(sample: DataFrame) -> list[list[float]]:
    """Cuts midway between neighbouring quantiles that differ."""
    shares = [i / (CUTS + 1) for i in range(CUTS + 2)]
    found = sample.agg(*(F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES)).first()
    steps = [sorted(set(found[f])) for f in FEATURES]
    return [[(a + b) / 2 for a, b in zip(s, s[1:])] for s in steps]


def _bin(value: Column, cuts: list[float]) -> Column:
    """The number of cuts below the value."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c < value))


def _gain(g: float, h: float) -> float:
    return g * g / (h + 1.0)


def _best(cells: dict[tuple[int, int], tuple[float, float]], cuts: list[list[float]]) -> tuple[tuple[int, int] | None, float]:
    """The split (feature, cut) of most gain, the first of equals; the leaf step without one."""
    g, h = (sum(v[i] for (f, _), v in cells.items() if f == 0) for i in (0, 1))
    best, chosen = 1e-3, None
    for f, edges in enumerate(cuts):
        gl = hl = 0.0
        for c in range(len(edges)):
            dg, dh = cells.get((f, c), (0.0, 0.0))
            gl, hl = gl + dg, hl + dh
            if hl >= 1 and h - hl >= 1 and (gain := round(_gain(gl, hl) + _gain(g - gl, h - hl) - _gain(g, h), 6)) > best:
                best, chosen = gain, (f, c)
    return chosen, RATE * g / (h + 1.0)


def _boost(binned: DataFrame, model: Model) -> None:
    """Adds trees, level by level: one aggregation of all open nodes gives their best splits.

    ``binned`` holds distinct (bins, label) with a weight, so that copies are one row.
    """
    at_most = lambda f, c: F.col("bins")[f] <= c
    for _ in range(TREES):
        margin = reduce(lambda a, b: a + b, (t.column(at_most) for t in model.trees), F.lit(model.prior))
        p = 1.0 / (1.0 + F.exp(-margin))
        tree = Node()
        open_nodes: dict[int, Node] = {1: tree}
        for depth in range(DEPTH + 1):
            place = _place(tree, at_most)
            rows = binned.withColumn("p", p).withColumn("node", place).where(F.col("node").isin(list(open_nodes)))
            rows = rows.select("node", F.posexplode("bins").alias("feature", "bin"), F.round((F.col("label") - F.col("p")) * F.col("n") * UNIT).cast("long").alias("g"), F.round(F.col("p") * (1.0 - F.col("p")) * F.col("n") * UNIT).cast("long").alias("h"))
            cells: dict[int, dict] = {k: {} for k in open_nodes}
            for r in rows.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                cells[r["node"]][r["feature"], r["bin"]] = (r["g"] / UNIT, r["h"] / UNIT)
            opened: dict[int, Node] = {}
            for k, node in open_nodes.items():
                chosen, node.step = _best(cells[k], model.cuts)
                if chosen and depth < DEPTH:
                    node.feature, node.cut = chosen
                    node.low, node.high = Node(), Node()
                    opened[2 * k], opened[2 * k + 1] = node.low, node.high
            open_nodes = opened
            if not open_nodes:
                break
        model.trees.append(tree)
        if tree.low is None:  # nothing is left to split
            break


def _place(node: Node, at_most, number: int = 1) -> Column:
    """The number of the leaf in which a row lies: 1 for the root, 2k and 2k + 1 below k."""
    if node.low is None:
        return F.lit(number)
    return F.when(at_most(node.feature, node.cut), _place(node.low, at_most, 2 * number)).otherwise(_place(node.high, at_most, 2 * number + 1))


def train(rows: DataFrame, statistics: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled rows, or on about ``sample`` of them chosen by hash if there are more.

    ``rows`` have ``url``, host, path, query and ``label`` (1 block, 0 allow, null unknown); counts and shares of suffixes come from all rows.
    """
    totals = statistics.where(F.col("cell") < BUCKETS).agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    known, blocked = int(totals[0]), int(totals[1])
    share = (blocked + 1) / (known + 2)
    model = Model(math.log(share / (1 - share)))
    if blocked in (0, known):
        return model
    labelled = rows.where(F.col("label").isNotNull())
    if known > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("id", "url"), F.lit(1 << 32)) < int((1 << 32) * sample / known))
    chosen = materialize(with_features(labelled, statistics).select(*FEATURES, "label"), "url-sample")
    if chosen.isEmpty():
        return model
    model.cuts = _cuts(chosen)
    bins = F.array(*(_bin(F.col(f), cuts) for f, cuts in zip(FEATURES, model.cuts)))
    binned = materialize(chosen.groupBy(bins.alias("bins"), "label").agg(F.count("*").alias("n")).coalesce(4), "url-bins")
    _boost(binned, model)
    drop_table(chosen)
    drop_table(binned)
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", label: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """Adds host, path, rule, score (the trees' probability of block) and verdict to each row.

    ``label`` (1 block, 0 allow, null unknown) is a column of ``pages``; by default the verdicts of the rules are the labels.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    own = F.lit(None).cast("int") if label is None else label.cast("int")
    rows = pages.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in kept)).alias("row"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), own.alias("label"))
    ids = [F.col("row").getField(c) for c, kind in pages.dtypes if c in kept and c != url and kind in ("bigint", "int", "string") and c.endswith("_id")]
    rows = with_rule(with_parts(rows), rules).withColumn("id", F.xxhash64(*ids) if ids else F.lit(0).cast("long"))
    if label is None:
        rows = rows.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    statistics = materialize(suffix_statistics(rows), "url-suffixes")
    model = train(rows, statistics, sample)
    judged = with_features(rows, statistics).withColumn("score", model.score())
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*(F.col("row").getField(c).alias(c) for c in kept), "host", "path", "rule", "score", verdict.alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")
