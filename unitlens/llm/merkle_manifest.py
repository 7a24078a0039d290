"""Merkle manifest of a table: a digest per row, a tree per group, one root, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens.llm.scratch import written

#: Children of a node.
ARITY = 3
#: Levels that one block holds; a block begins with ARITY ** LEVELS nodes, 46 KB of digests.
LEVELS = 6
BLOCK = ARITY**LEVELS
#: Characters of a hex digest.
HEX = 64


def digest(*parts: Column) -> Column:
    """SHA-256 of strings put together, as lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that can't run into the next one: its length in bytes, a colon, the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def numbered(nodes: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place from 0 in its group, and ``total``, the group's size.

    Rows are sorted by ranges and numbered in their task; only the tasks' counts meet in a window, so a
    group may hold all rows. Rows that agree in ``order`` and in all else are dealt by their place in the
    scan, so equal rows are no hot range either.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("tie")]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)))
    runs = placed.groupBy(F.col(group).alias("of"), F.col("task").alias("run")).agg(
        F.min("at").alias("first"), F.count("*").alias("n")
    )
    whole = Window.partitionBy("of")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "of", "run", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total")
    )
    both = placed.join(runs, F.col(group).eqNullSafe(F.col("of")) & (F.col("task") == F.col("run")))
    return both.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "task", "of", "run", "shift")


def over(value: Column, n: int) -> Column:
    return F.call_function("div", value, F.lit(n))


def parents(level: Column) -> Column:
    """The next level of a block: every ARITY digests of the string become one."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (ARITY * HEX)).cast("int") - 1)
    return F.array_join(
        F.transform(runs, lambda k: F.sha2(F.substring(level, k * (ARITY * HEX) + 1, F.lit(ARITY * HEX)).cast("binary"), 256)), ""
    )


def climb(nodes: DataFrame, group: str, carried: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One step of LEVELS levels. ``nodes`` has the group, pos, total, node and what is carried.

    Gives the nodes with ``block`` and ``path``, the siblings on their left and right by level, and
    the blocks as the nodes of the next step. A level is a string of digests of one width, so a
    parent hashes one substring, and siblings are the substrings beside a node. Levels are cut
    as bytes: a slice there needs no walk over the characters before it.
    """
    member = F.struct("pos", "node", *carried)
    blocks = nodes.groupBy(group, over(F.col("pos"), BLOCK).alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members")
    )
    blocks = blocks.withColumn("level0", F.array_join("members.node", "").cast("binary"))
    for k in range(LEVELS):
        below = F.col(f"level{k}")
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("total") > ARITY**k, parents(below).cast("binary")).otherwise(below))
    steps = []
    for k in range(LEVELS):
        level, place = F.col(f"level{k}"), over(F.col("m.pos") % BLOCK, ARITY**k).cast("int")
        child = place % ARITY
        left = F.substring(level, (place - child) * HEX + 1, child * HEX)
        right = F.substring(level, (place + 1) * HEX + 1, (ARITY - 1 - child) * HEX)
        steps.append(F.when(F.col("total") > ARITY**k, F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))))
    members = written(
        blocks.withColumn("m", F.explode("members")).select(
            group, "block", "total", F.col(f"level{LEVELS}").cast("string").alias("top"), "m.*", F.array_compact(F.array(*steps)).alias("path")
        )
    )
    tops = members.where(F.col("pos") % BLOCK == 0).select(
        group, F.col("block").alias("pos"), over(F.col("total") + (BLOCK - 1), BLOCK).alias("total"), F.col("top").alias("node")
    )
    return members.drop("total", "top"), tops


def rooted(nodes: DataFrame, group: str, order: Sequence[str], carried: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """All steps of the trees of ``nodes`` (group, node, ...): their rows from the leaves up, and (group, node) of each tree's top."""
    level, steps = numbered(nodes, group, order), []
    most = level.agg(F.max("total")).first()[0] or 1
    while True:
        members, level = climb(level, group, () if steps else carried)
        steps.append(members)
        most = -(-most // BLOCK)
        if most <= 1:
            return steps, level.select(group, "node")


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda below, step: digest(step["left"], below, step["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings on the way to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "source",
    claimed: Column | None = None,
) -> DataFrame:
    """Per row of ``docs``: the key, the group, leaf, claimed, subroot, root and path.

    A leaf is the digest of ``columns``; leaves of a group ascend by key. While a tree has several nodes,
    every three consecutive ones, at the end also fewer, become their digest; a lone leaf is its own
    subroot. Subroots ascend by group, null first, and give the root in the same way. ``path`` has the
    siblings at every level from the leaf to the root; ``claimed`` is the digest that ``claimed`` gives
    for the row, the leaf by default, and ``folded(claimed, path)`` is the root if and only if it is the leaf.

    Null keys come first in their group, a null group is a group; null values and empty texts have
    different leaves. Rows of one key ascend by their leaves, so the result doesn't depend on the order of
    repeated rows. Other columns are ignored, whatever their names; an empty table gives no rows. Texts are read once
    and only their digests go on. A group may hold any part of the rows: blocks of 729 leaves are the only
    unit that is gathered, and what a row needs from above comes to it by its block.
    """
    made = leaf(*[F.col(c) for c in columns])
    leaves = written(
        docs.select(F.col(key).alias("key"), F.col(group).alias("of_group"), made.alias("node"), (made if claimed is None else claimed).alias("claimed"))
    )
    steps, tops = rooted(leaves, "of_group", ["key", "node", "claimed"], ["key", "claimed"])
    named = tops.select(F.lit(0).alias("all"), F.col("of_group").alias("name"), F.col("of_group").isNotNull().alias("given"), "node")
    above, top = rooted(named, "all", ["given", "name"], ["name", "given"])
    root = top.select(F.col("node").alias("root"))

    def down(members: DataFrame, upper: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
        """Paths of ``members``, continued by those of the blocks that they are in."""
        upper = upper.select(*[F.col(k).alias(f"u_{k}") for k in keys], F.col("pos").alias("u_pos"), F.col("path").alias("u_path"), *more)
        same = F.col("block") == F.col("u_pos")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"u_{k}"))
        joined = members.join(upper, same)
        return joined.withColumn("path", F.concat("path", "u_path")).drop("u_pos", "u_path", *[f"u_{k}" for k in keys])

    # One row, the root, is a scalar; the paths from the subroots up join the last step of the groups' trees only.
    upper = above[-1].withColumn("root", root.scalar())
    for members in reversed(above[:-1]):
        upper = down(members, upper, ["all"], ["root"])
    ways = upper.select(F.col("name").alias("w_name"), F.col("node").alias("subroot"), F.col("path").alias("w_path"), "root")
    rows = steps[-1].join(ways, F.col("of_group").eqNullSafe(F.col("w_name")))
    rows = written(rows.withColumn("path", F.concat("path", "w_path")).drop("w_name", "w_path"))
    for members in reversed(steps[:-1]):
        rows = down(members, rows, ["of_group"], ["subroot", "root"])
    return rows.select(F.col("key").alias(key), F.col("of_group").alias(group), F.col("node").alias("leaf"), "claimed", "subroot", "root", "path")
