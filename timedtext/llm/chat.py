r"""Chat formatting: the best root-to-leaf path of every reply tree as one conversation.

Trees are followed by self-joins that double the distance: after round k a node knows its
2^k-th ancestor and the score down from it, so a path of n turns takes log2(n) rounds and no row
ever holds a whole path. The leaf whose path has the highest total score wins (ties: the
smallest node); its path is marked by the same tables in reverse. Then every tree's path is put
together, one string per conversation, which is the result's own unit.

A turn is ``### role: text</turn>`` and a line break. Inside roles and texts a backslash is
written ``\s``, ``###`` is ``\h``, ``</turn>`` is ``\e`` and, in roles, a colon is ``\c``: no
control string is left, and reading back is exact. The loss mask is the text of each assistant
turn: turn, start and length in characters of that turn's part.

Defined results: null texts and roles are empty. A node whose parent is not in the table is a
root; nodes on a circle have no root and are in no path. A null tree or conversation id is an id
like others. In a conversation table a row's parent is the row before it, by turn (nulls
first), role and text; so repeated rows and turns are turns of their own. Further columns are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timedtext.llm.common import table
from timedtext.session import stage_table

TURN_END = "</turn>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("###", "\\h"), (TURN_END, "\\e")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\c", ":"), ("\\e", TURN_END), ("\\h", "###"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def best_paths(nodes: DataFrame) -> DataFrame:
    """Of nodes (tree, node, parent, score), those on the best path of their tree, with their
    ``depth`` from 0 at the root: (tree, node, depth)."""
    nodes = stage_table(nodes.select("tree", "node", "parent", "score"), "nodes")

    def jump(near: DataFrame, far: DataFrame) -> DataFrame:
        far = far.toDF("tree_f", "node_f", "up_f", "score_f", "steps_f")
        same = near["tree"].eqNullSafe(far["tree_f"]) & (near["up"] == far["node_f"])
        return near.join(far, same, "left")

    start = nodes.select("tree", "node", F.col("parent").alias("up"), "score", F.lit(0).alias("steps"))
    linked = jump(start, start)
    level = linked.select(
        "tree",
        "node",
        F.col("node_f").alias("up"),
        "score",
        F.when(F.col("node_f").isNotNull(), 1).otherwise(0).alias("steps"),
    )
    # ``score`` and ``steps`` cover the nodes from this one up to, but without, ``up``.
    levels = [stage_table(level, "level")]
    n = levels[0].count()

    def finished(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, (x.filter("up IS NULL") for x in tables))

    # Only nodes that have not reached their root go on, so a long tree costs the others nothing.
    while (1 << len(levels)) <= 2 * n and not levels[-1].filter("up IS NOT NULL").isEmpty():
        near = levels[-1].filter("up IS NOT NULL")
        linked = jump(near, near.unionByName(finished(levels)))
        level = linked.select(
            "tree",
            "node",
            F.col("up_f").alias("up"),
            (F.col("score") + F.coalesce("score_f", F.lit(0))).alias("score"),
            (F.col("steps") + F.coalesce("steps_f", F.lit(0))).alias("steps"),
        )
        levels.append(stage_table(level, "level"))
    whole = finished(levels)
    inner = levels[0].filter("up IS NOT NULL").select("tree", F.col("up").alias("inner")).distinct()
    inner = inner.withColumnRenamed("tree", "tree_i")
    leaves = whole.join(
        inner, whole["tree"].eqNullSafe(inner["tree_i"]) & (whole["node"] == inner["inner"]), "left_anti"
    )
    best = leaves.groupBy("tree").agg(F.max(F.struct("score", (-F.col("node")).alias("turned"))).alias("best"))
    marked = stage_table(best.select("tree", (-F.col("best")["turned"]).alias("node")), "path")
    for level in reversed(levels):
        up = level.filter("up IS NOT NULL").select(F.col("tree").alias("tree_u"), F.col("node").alias("node_u"), "up")
        above = marked.join(up, marked["tree"].eqNullSafe(up["tree_u"]) & (marked["node"] == up["node_u"]))
        marked = marked.union(above.select("tree", F.col("up").alias("node"))).distinct()
        marked = stage_table(marked, "path")  # used twice by the next round: keeps the plan small
    depth = whole.select(F.col("tree").alias("tree_d"), F.col("node").alias("node_d"), F.col("steps").alias("depth"))
    found = marked.join(depth, marked["tree"].eqNullSafe(depth["tree_d"]) & (marked["node"] == depth["node_d"]))
    return stage_table(found.select("tree", "node", "depth"), "path")


def format_turns(turns: DataFrame) -> DataFrame:
    """Of turns (conv_id, depth, role, text), one row per conversation: ``formatted`` and
    ``loss``, the mask."""
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    body = escape(F.col("text"))
    rows = turns.select(
        "conv_id",
        "depth",
        F.concat(head, body, F.lit(TURN_END)).alias("part"),
        F.when(
            F.col("role") == ASSISTANT,
            F.struct(F.length(head).alias("start"), F.length(body).alias("length")),
        ).alias("mask"),
    )
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "part", "mask"))).alias("turns")
    )
    parts = F.transform("turns", lambda t: F.concat(t["part"], F.lit("\n")))
    loss = F.transform(
        "turns",
        lambda t, i: F.struct(i.alias("turn"), t["mask"]["start"].alias("start"), t["mask"]["length"].alias("length")),
    )
    return grouped.select(
        "conv_id",
        F.array_join(parts, "").alias("formatted"),
        F.filter(loss, lambda x: x["start"].isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, the turns (role, text) and the masked texts, from the formatted string."""
    parts = F.split("formatted", TURN_END + "\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substring(part, 5, 2**31 - 1), ": ", 1)
        text = F.substr(part, F.length(role) + F.lit(7))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    rows = formatted.select("conv_id", "formatted", "loss", parts.alias("parts"))
    masked = F.transform(
        "loss",
        lambda m: unescape(F.substr(F.get("parts", m["turn"]), m["start"] + F.lit(1), m["length"])),
    )
    return rows.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), masked.alias("masked"))


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """A conversation table as trees that are chains."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("conv_id", F.row_number().over(order).alias("node"), "role", "text")


def format_conversations(rows: DataFrame) -> DataFrame:
    nodes = stage_table(conversation_nodes(rows), "turns")
    chosen = best_paths(
        nodes.select(
            F.col("conv_id").alias("tree"),
            "node",
            (F.col("node") - 1).alias("parent"),
            F.length("text").cast("bigint").alias("score"),
        )
    ).withColumnRenamed("node", "of_node")
    same = nodes["conv_id"].eqNullSafe(chosen["tree"]) & (nodes["node"] == chosen["of_node"])
    return format_turns(nodes.join(chosen, same).select("conv_id", "depth", "role", "text"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    read = read_back(format_conversations(rows.unionByName(planted)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join("masked", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(masked).cast("bigint").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS r,
    replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e') AS t
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(r) + length(t)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
