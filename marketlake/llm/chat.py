"""Operator 9, chat formatting of reply trees.

Pointer doubling enumerates root-to-leaf paths by self-joins: after round k every message knows its ancestor 2^k steps up and
the score total on the way, so that depth d takes log2(d) rounds. Leaves are ranked by mean score along their path;
the ancestors of each chosen leaf are gathered by walking the stored rounds from the largest step down, which meets each
ancestor once and knows its depth; ``PLANNED`` rounds are one plan, whose size grows with the rounds. Each chosen path becomes one formatted conversation with a loss mask over assistant texts.

The template is ``<turn>### role: text</turn>`` and a line feed per turn. Inside roles and texts a backslash becomes
``\\b``, ``<`` becomes ``\\l``, ``#`` becomes ``\\h`` and, in roles, ``:`` becomes ``\\c``; undoing these in reverse order
restores the text, since every backslash left is the first character of one code.

Defined results: all messages of a null tree (``conv_id``) are one tree, as in GROUP BY; a null text or role counts as empty; a null score as 0; a parent that does not exist makes its child a root; messages in or
below a cycle are on no path; ties of score go to the smaller leaf; of rows that repeat a message (tree and node) the least by parent,
score, role and text counts, nulls first; repeated rows of one turn of a thread follow each other by role and text; extra columns are left out;
an empty table gives no rows. Texts of a conversation meet in one row, as its output is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

OPEN, MIDDLE, CLOSE = "<turn>### ", ": ", "</turn>\n"
_CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
#: Rounds that the walk to the root joins in one plan before it writes its paths.
PLANNED = 4
PROBE_TEXT = "\\### Assistant: </turn> ok"


def escape(x: Column, role: bool = False) -> Column:
    for plain, code in (*_CODES, *([(":", "\\c")] if role else [])):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for plain, code in reversed((*_CODES, (":", "\\c"))):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def one_per_node(messages: DataFrame) -> DataFrame:
    """One row per message; the tree is a struct, which is never null whatever it holds, so that joins meet a null tree too."""
    held = [c for c in ("parent", "score", "role", "text") if c in messages.columns]
    least = messages.groupBy(F.struct("tree").alias("tree"), "node").agg(F.min(F.struct(*held)).alias("m"))
    return least.select("tree", "node", "m.*")


def _counted(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int, int]:
    """``df`` materialized, its rows and those whose ``column`` is not null, counted as they are written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(column).alias("held")), name)
    return table, seen.get["rows"], seen.get["held"]


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the ``keep`` best root-to-leaf paths of each tree of (tree, node, parent, score)."""
    m = one_per_node(messages.select("tree", "node", "parent", "score"))
    m, most, live = _counted(m.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "parent", "messages")
    step = m.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    rounds: list[DataFrame] = []
    while True:
        rounds.append(step)
        if not live or 1 << (len(rounds) - 1) > most:
            break
        ahead = step.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        step, _, live = _counted(
            step.where("up IS NOT NULL").join(ahead, ["tree", "up"], "left").select(
                "tree", "node", F.col("next").alias("up"),
                (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"),
            ).unionByName(step.where("up IS NULL")),
            "up", "ancestors",
        )
    rooted = step.where("up IS NULL").select("tree", "node", "total", "depth")
    leaves = rooted.join(m.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    path = leaves.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= keep).select("tree", F.col("node").alias("leaf"), "node", "depth")
    for k in reversed(range(len(rounds) - 1)):
        # A row of round k that is not settled is 2^k steps below its ``up``; a parent that does not exist would be at depth 0.
        up = rounds[k].where("up IS NOT NULL").select("tree", "node", "up")
        met = F.expr(f"IF(up IS NULL OR depth <= {1 << k}, array(struct(node, depth)), array(struct(node, depth), struct(up AS node, depth - {1 << k} AS depth)))")
        path = path.join(up, ["tree", "node"], "left").select("tree", "leaf", F.inline(met))
        if k and k % PLANNED == 0:
            path = materialize(path, "paths")
    return path.select(F.col("tree.tree").alias("tree"), "node", "leaf", "depth")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): the conversation of each path and the spans (code points) that bear loss."""
    text, role = escape(F.coalesce("text", F.lit(""))), escape(F.coalesce("role", F.lit("")), role=True)
    turn = F.struct("depth", F.concat(F.lit(OPEN), role, F.lit(MIDDLE)).alias("head"), text.alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("bears"))
    tree = F.struct("tree").alias("tree")
    joined = paths.withColumn("tree", tree).join(one_per_node(messages).select("tree", "node", "role", "text"), ["tree", "node"])
    gathered = joined.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(
                t["bears"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return gathered.select(F.col("tree.tree").alias("tree"), "leaf", formatted.alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    pieces = F.split(formatted, CLOSE, -1)
    rest = lambda p: F.substring(p, len(OPEN) + 1, F.length(p))
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(rest(p), MIDDLE, 1)).alias("role"),
            unescape(F.substring(rest(p), F.length(F.substring_index(rest(p), MIDDLE, 1)) + len(MIDDLE) + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of linear threads: each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    rows = conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], "conv_id long, turn int, role string, text string")
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = materialize(threads(table), "threads")
    chats = materialize(format_paths(best_paths(messages), messages), "chats")
    turns = read_turns(F.col("formatted"))
    listed = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read_loss(F.col("formatted"), F.col("loss"))
    return chats.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(role) + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
