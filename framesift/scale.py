"""Keeping every task's share of the rows bounded, whatever the keys look like.

Most folders, stacks and sittings are small, and a window over them is the
cheapest plan there is. But one may hold most of everything. So rows whose
order matters are laid out first (:func:`laid`): keys with more than a task's
share of the rows are cut into blocks of their order, and nothing else changes.
Windows then are by key and block, in the same plan for rows of all keys, and
what goes over a block's edge is told by one row a block: the values a block
ends with (:func:`carry`, :func:`previous`), or the groups that lie in several
(:func:`attach`). Whatever the table's size there are a few blocks for each
shuffle partition, so these rows are put together in the driver and broadcast.

Shares are of the table, so small tables and big ones are treated alike. Many-to-one
joins (:func:`lookup`) are plain joins, whose hot keys adaptive execution deals
over tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.sources import shared

# Says which block of its key a row is in, from 1; 0 where the key isn't cut.
BLOCK = "_block"
# Blocks of a task's share of the rows, and rows looked at to find where each ends.
BLOCKS, LOOKS = 4, 8
# Rows a task that sorts them is dealt.
MOST, LEAST = 1 << 20, 1 << 16


def laid(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows with ``_block`` if some key has more than its share: more rows than
    a shuffle partition has on average. Without such a key, the rows as they are.

    Such keys are fewer than partitions. Where there are any, the rows are
    written to the shared folder once, bucketed by key and block, so that what
    follows shuffles nothing; give it the columns that are needed. Cuts are found
    among rows picked by hash, the same on every run.
    """
    spark, rows = rows.sparkSession, rows.drop(BLOCK)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most * parts <= total:
        return rows
    hot = counts.where(F.col("_n") * parts > total).select(*keys)
    every = max(total // (parts * BLOCKS * LOOKS), 1)
    looked = lookup(rows.select(*keys, order), F.broadcast(hot), keys, "left_semi").where(F.pmod(F.xxhash64(order), F.lit(every)) == 0)
    found = looked.groupBy(*keys).agg(F.array_sort(F.collect_set(order)).alias("_all")).select(
        *keys, F.filter("_all", lambda _, at: at % LOOKS == LOOKS - 1).alias("_cuts"))
    cuts = _few(found)
    longest = max((len(c) for c in cuts.column("_cuts").to_pylist()), default=0)
    # How many cuts are at or before the row, by halving.
    at = F.aggregate(
        F.array(*(F.lit(1 << bit) for bit in reversed(range(max(longest, 1).bit_length())))),
        F.lit(0),
        lambda done, step: F.when(F.get("_cuts", done - 1 + step) <= F.col(order), done + step).otherwise(done),
    )
    cut = lookup(rows, _back(spark, cuts), keys).withColumn(BLOCK, F.when(F.col("_cuts").isNull(), 0).otherwise(at + 1)).drop("_cuts")
    block = F.col(BLOCK).alias(BLOCK, metadata={"keys": list(keys), "order": order})
    name = f"laid_{uuid.uuid4().hex}"
    cut.select(*rows.columns, block).write.bucketBy(parts, *keys, BLOCK).option("path", shared.folder(spark, "laid")).saveAsTable(name)
    return spark.table(name)


def dealt(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The rows, of which there are ``n``, by keys to tasks that sort them: a task
    gets some ``MOST`` rows, and no fewer than ``LEAST`` to have more tasks than
    a shuffle has. Adaptive execution would put as many together as there are cores,
    by their size as they are packed."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(-(-n // MOST), min(parts, -(-n // LEAST)), 1), *keys)


def is_laid(rows: DataFrame) -> bool:
    return BLOCK in rows.columns


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(Column.__and__, (a.eqNullSafe(b) for a, b in zip(left, right)))


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows to a table with one row a key, or few, on keys that may be null;
    the table's copies of the keys are dropped."""
    renamed = table.withColumnsRenamed({key: f"_on_{key}" for key in keys})
    condition = _same([rows[key] for key in keys], [renamed[f"_on_{key}"] for key in keys])
    return rows.join(renamed, condition, how).drop(*(f"_on_{key}" for key in keys))


def _few(rows: DataFrame) -> pa.Table:
    """A row or so a block, in the driver; plans then don't hold what made them."""
    return rows.toArrow()


def _back(spark: SparkSession, rows: pa.Table) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows))


def spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The groups of rows that lie in more than one block; None if there are none.
    Groups have to be stretches of the order: what the rows are laid out by,
    or runs in it. Then only the first and last of a block can."""
    if not is_laid(rows):
        return None
    laid_by = rows.schema[BLOCK].metadata
    order, group = laid_by["order"], F.struct(*keys)
    ends = _few(rows.where(F.col(BLOCK) > 0).groupBy(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(laid_by["keys"])), BLOCK).agg(
        F.min_by(group, order).alias("first"), F.max_by(group, order).alias("last")))
    ends = ends.sort_by([(c, "ascending") for c in ends.column_names[:-2]])
    firsts, lasts = ends.column("first").to_pylist(), ends.column("last").to_pylist()
    over = [k for k in range(len(lasts) - 1) if lasts[k] == firsts[k + 1] and (k == 0 or lasts[k] != lasts[k - 1])]
    if not over:
        return None
    found = ends.column("last").combine_chunks().take(over)
    return _back(rows.sparkSession, pa.Table.from_arrays(found.flatten(), schema=pa.schema(list(found.type))))


def attach(rows: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], over: DataFrame | None | str = "find") -> DataFrame:
    """Give every row its group's aggregates.

    A group in one block is a window; those of several (``over``, as
    :func:`spans` finds them) are aggregated by themselves, combined in the tasks.
    """
    if not is_laid(rows):
        w = Window.partitionBy(*keys)
        return rows.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
    over = spans(rows, keys) if isinstance(over, str) else over
    w = Window.partitionBy(*dict.fromkeys([*rows.schema[BLOCK].metadata["keys"], BLOCK, *keys]))
    within = rows.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
    if over is None:
        return within
    whole = lookup(rows, over, keys, "left_semi").groupBy(*keys).agg(*(agg.alias(f"_w_{name}") for name, agg in aggregates.items()))
    joined = lookup(within, _back(rows.sparkSession, _few(whole.withColumn("_over", F.lit(True)))), keys)
    return joined.withColumns(
        {name: F.when(F.col("_over"), F.col(f"_w_{name}")).otherwise(F.col(name)) for name in aggregates}
    ).drop("_over", *(f"_w_{name}" for name in aggregates))


def carry(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    *,
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Give every row the last non-null of each value up to it, in order.

    ``inclusive`` counts the row itself; ``backward`` looks from the end, for
    the next one instead of the last. Laid-out rows have to be laid out by
    these keys and this order.
    """
    direction = F.desc if backward else F.asc
    block = [BLOCK] if is_laid(rows) else []
    w = Window.partitionBy(*keys, *block).orderBy(direction(order))
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    within = rows.withColumns({name: F.last(v, ignorenulls=True).over(w) for name, v in values.items()})
    if not block:
        return within
    # The last value in each block; then the last before each block.
    ends = F.min_by if backward else F.max_by
    edges = _few(rows.where(F.col(BLOCK) > 0).groupBy(*keys, BLOCK).agg(
        *(ends(v, F.when(v.isNotNull(), F.col(order))).alias(f"_e_{name}") for name, v in values.items())))
    found, last, of = [], {}, None
    for edge in edges.sort_by([*((k, "ascending") for k in keys), (BLOCK, "descending" if backward else "ascending")]).to_pylist():
        if of != (of := [edge[k] for k in keys]):
            last = {}
        found.append({**edge, **{f"_e_{name}": last.get(name) for name in values}})
        last.update({name: edge[f"_e_{name}"] for name in values if edge[f"_e_{name}"] is not None})
    before = _back(rows.sparkSession, pa.Table.from_pylist(found, edges.schema))
    joined = lookup(within, before, [*keys, BLOCK])
    return joined.withColumns({name: F.coalesce(name, f"_e_{name}") for name in values}).drop(*(f"_e_{name}" for name in values))


def previous(rows: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column]) -> DataFrame:
    """Give every row the values of the row before it (null on the first)."""
    if not is_laid(rows):
        w = Window.partitionBy(*keys).orderBy(order)
        return rows.withColumns({name: F.lag(v).over(w) for name, v in values.items()})
    # A struct is never null, so the last non-null one is the row before's.
    whole = F.struct(*(v.alias(name) for name, v in values.items()))
    carried = carry(rows, keys, order, {"_row_before": whole}, inclusive=False)
    return carried.withColumns({name: F.col(f"_row_before.{name}") for name in values}).drop("_row_before")
