"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens.llm.scratch import written
from unitlens.llm.text import MULTIPLIER, WHITE_SPACE_RUN, mix

#: Documents rounded together, and residuals of one node of the tree.
LEAF, FAN = 4096, 4096


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE_RUN), lambda w: w != "")
    return F.size(found).cast("long")


def ranked(sources: DataFrame, order: Column, parts: int = 32) -> DataFrame:
    """``sources`` with ``rank``, counted from 0 in the given order, over ranges and without one large task."""
    ranged = sources.repartitionByRange(parts, order).sortWithinPartitions(order)
    placed = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = placed.groupBy("part").count().collect()  # one row per range
    offset, before = F.lit(0), 0
    for row in sorted(counts):
        offset = F.when(F.col("part") == row["part"], F.lit(before)).otherwise(offset)
        before += row["count"]
    return placed.withColumn("rank", offset + F.col("at") % (1 << 33)).drop("part", "at")


def source_targets(
    sized: DataFrame, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), cap: float = 2.0
) -> DataFrame:
    """Per source of ``sized`` (source, size): rank, n_docs, source_size, target.

    The sources by code point, null last, take the weights in turn and share ``share`` times the whole
    size. A target stops at ``cap`` times its source; what exceeds is shared again by weight until no
    target is above. Each turn of that is one small sum over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_rank = ranked(sources, F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = written(by_rank.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int"))))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("source_size") * cap if stopped >= 0 else F.lit(False)
        row = weighed.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (share * total - cap * row["held"]) / row["open"]
    if total and not row["open"]:
        target = F.col("source_size") * F.lit(float(cap))
    else:
        target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(level))
    return weighed.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def settle(p: np.ndarray, size: np.ndarray, luck: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one group: settled probabilities, and the place of the one left open or -1.

    The open unit meets the next one: expected words move from one to the other until one of them is
    0 or 1, the direction drawn so that both keep their expectation. The sum of p * size stays.
    """
    p = p.copy()
    empty = size == 0
    p[empty] = luck[empty] < p[empty]
    here = -1
    for k in np.flatnonzero((p > 0) & (p < 1)).tolist():
        if here < 0:
            here = k
            continue
        a, b, s, t = p[here], p[k], size[here], size[k]
        up = min((1 - a) * s, b * t)  # words that here can take from k
        down = min(a * s, (1 - b) * t)
        moved = up if luck[k] * (up + down) < down else -down
        a, b = a + moved / s, b - moved / t
        a, b = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (a, b))
        p[here], p[k] = a, b
        if not 0 < a < 1:
            here = k if 0 < b < 1 else -1
    return p, here


def rounded(carried: Sequence[str]):
    """Round one group of units (id, p, size, key); the open one keeps its fraction."""

    def run(table: pa.Table) -> pa.Table:
        # Large units meet first, so what is open in the end is small.
        table = table.sort_by([("size", "descending"), *((c, "ascending") for c in ("key", *carried))])
        key = table["key"].to_numpy().astype(np.int64).view(np.uint64)
        luck = (mix(key + MULTIPLIER) >> np.uint64(11)) / float(1 << 53)
        p, here = settle(table["p"].to_numpy(), table["size"].to_numpy(), luck)
        is_open = np.zeros(len(p), bool)
        if here >= 0:
            is_open[here] = True
        table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))
        return table.append_column("open", pa.array(is_open))

    return run


def schema_of(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + list(more))


def numbered_repeats(sized: DataFrame) -> DataFrame:
    """``sized`` with ``repeat``, which counts the rows of one doc_id and size from 0.

    Rows are sorted and numbered in their tasks, and a task's numbers go on from those of the tasks before it; of
    a group only its counts per task meet.
    """
    placed = sized.sortWithinPartitions("doc_id", "size").withColumn("at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("task", F.shiftright("at", 33)))
    runs = placed.groupBy("doc_id", "size", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    same = Window.partitionBy("doc_id", "size")
    before = same.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"all": F.sum("n").over(same), "before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    shifts = runs.where(F.col("all") > 1).select(
        F.col("doc_id").alias("of_id"), F.col("size").alias("of_size"), F.col("task").alias("of_task"), (F.col("before") - F.col("first")).alias("shift")
    )
    this = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("size") == F.col("of_size")) & (F.col("task") == F.col("of_task"))
    joined = placed.join(shifts, this, "left")
    return joined.withColumn("repeat", F.coalesce(F.col("at") + F.col("shift"), F.lit(0))).select(*sized.columns, "repeat")


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 2.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_id, ``carry``, source, size, source_size, target, copies, taken.

    Each row of a source gets target / source_size copies in expectation: the whole part for certain,
    the rest by dependent rounding, so a source's taken words miss its target by less than one
    document. Rounds work on hashed leaves of about LEAF documents, then on their residuals, FAN at a
    time; a source of any size is many leaves. Draws depend on doc_id and size only, and among rows that agree
    in both on their number, so reruns agree and many such rows are many leaves too.
    A text that is null or empty has size 0; null is a source of its own; rows that repeat are rounded
    one by one; rows without doc_id likewise; an empty table gives no rows; other columns are ignored.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), *carry, F.col(source).alias("source"), words(F.col(text)).alias("size")
    )
    sized = written(numbered_repeats(sized))
    targets = source_targets(sized, share, weights, cap)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    key = F.xxhash64("doc_id", "size", "repeat")
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / LEAF))
    units = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        *carry,
        "source",
        F.col("size").cast("double").alias("size"),
        "source_size",
        "target",
        F.floor(rate).alias("whole"),
        (rate - F.floor(rate)).alias("p"),
        "rank",
        F.pmod(key, leaves).alias("node"),
        F.xxhash64(F.lit(1), key).alias("key"),
    )
    leaf = written(
        units.groupBy("rank", "node").applyInArrow(rounded(("doc_id", *carry)), schema_of(units, "open boolean"))
    )
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / LEAF))).first()[0] or 1
    levels = []
    rest = leaf.where("open").select("rank", "node", "p", "size")
    for _ in range(max(1, math.ceil(math.log(most, FAN)))):
        grouped = rest.withColumn("key", F.xxhash64(F.lit(2 + len(levels)), "rank", "node"))
        grouped = grouped.withColumn("up", F.floor(F.col("node") / FAN))
        done = written(grouped.groupBy("rank", "up").applyInArrow(rounded(("node",)), schema_of(grouped, "open boolean")))
        levels.append(done)
        rest = done.where("open").select("rank", F.col("up").alias("node"), "p", "size")
    # One unit of a source is left; it goes to the nearer side.
    verdict = rest.select("rank", "node", (F.col("p") >= 0.5).cast("long").alias("take"))
    for done in reversed(levels):
        verdict = done.join(verdict.select("rank", F.col("node").alias("up"), "take"), ["rank", "up"], "left").select(
            "rank", "node", F.when(F.col("open"), F.col("take")).otherwise(F.col("p").cast("long")).alias("take")
        )
    copies = F.col("whole") + F.when(F.col("open"), F.col("take")).otherwise(F.col("p").cast("long"))
    size = F.col("size").cast("long")
    return leaf.join(verdict.select("rank", "node", "take"), ["rank", "node"], "left").select(
        "doc_id", *carry, "source", size.alias("size"), "source_size", "target", copies.alias("copies"), (copies * size).alias("taken")
    )
