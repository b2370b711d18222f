"""Folds over ordered groups of any size: a group is cut into blocks, and what a block does to every state it may begin in is worked out first.

The budget's fold has few states: how much is used, or stopped. A block of rows is then a table from state to state; tables compose, so that each
block's first state follows from those before it without reading rows, and all blocks are folded at once. No task holds a group, only a
block of BLOCK rows. Blocks are files in the shared folder, read by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.shared import make_dir, scratch, store_of, stored

BLOCK = 20_000


def _step(table: np.ndarray, a: int, b: int, most: int) -> np.ndarray:
    """States after a row, by the states before it; most + 1 is stopped. Sizes below zero don't exist."""
    first = np.where((a >= 0) & (table + a <= most), table + a, np.where((b >= 0) & (table + b <= most), table + b, most + 1))
    return np.where(table > most, most + 1, first)


def budget(rows: DataFrame, most: int, order: Column, first: Column, second: Column, *group: str) -> DataFrame:
    """(group..., id, text, total) of the rows that the budget's fold takes in each group, by order and id: `first` if it fits what is left of
    `most`, else `second`, else stop. As compress.budget, for groups of any size. A null text fits nothing; rows that tie in order
    and id go by their texts. Null groups are a group.
    """
    spark = rows.sparkSession
    folder = scratch(spark, "folds")
    make_dir(spark, folder)
    kept = rows.select(*group, order.alias("_o"), F.col("id").cast("long").alias("id"), first.alias("_a"), second.alias("_b"))
    kept = stored(kept.withColumns({"_la": F.coalesce(F.length("_a"), F.lit(-1)), "_lb": F.coalesce(F.length("_b"), F.lit(-1))}), "rows")
    by = [*group, "_o", "id", "_a", "_b"]
    n = max(1, -(-kept.count() // BLOCK))
    laid = kept.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())

    def starts(t: pa.Table) -> np.ndarray:
        """Where groups begin."""
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in group:
            codes = t.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        held, size, number = [], 0, 0

        def put() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held)
            name = f"{uuid.uuid4().hex}.parquet"
            with store.open_output_stream(f"{path}/{name}") as f:
                pq.write_table(t, f, compression="zstd")
            begins = starts(t)
            a, b = t.column("_la").to_numpy()[begins[-1] :], t.column("_lb").to_numpy()[begins[-1] :]
            table = np.arange(most + 2)
            for x, y in zip(a, b, strict=True):
                table = _step(table, x, y, most)
                if (table > most).all():
                    break
            whole = len(begins) == 1
            same = (table == table[0]).all()
            out = pa.Table.from_pydict({"path": [f"{folder}/{name}"], "part": pa.array([t.column("_part")[0].as_py()], pa.int32()), "number": pa.array([number], pa.int32()), "whole": [whole], "end": pa.array([int(table[0])], pa.int32()), "ends": pa.array([None if same or not whole else table.tolist()], pa.list_(pa.int32()))})
            first, last = (pa.Table.from_arrays([t.column(c).slice(k, 1) for c in group], [f"{s}_{c}" for c in group]) for s, k in (("first", 0), ("last", t.num_rows - 1)))
            number += 1
            for extra in (first, last):
                for c in extra.column_names:
                    out = out.append_column(c, extra.column(c))
            return out.combine_chunks().to_batches()[0]

        for x in batches:
            for k in range(0, x.num_rows, BLOCK):
                held.append(x.slice(k, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    kinds = dict(kept.dtypes)
    ends = "".join(f", first_{c} {kinds[c]}" for c in group) + "".join(f", last_{c} {kinds[c]}" for c in group)
    blocks = stored(laid.mapInArrow(write, "path string, part int, number int, whole boolean, end int, ends array<int>" + ends), "blocks")
    begin, before, carried = [], None, 0
    for r in sorted(blocks.collect(), key=lambda r: (r.part, r.number)):  # a few numbers for each block of rows
        own = tuple(r[f"first_{c}"] for c in group)
        state = carried if before == own else 0
        begin.append((r.path, state))
        carried = (r.ends[state] if r.ends else r.end) if r.whole else r.end
        before = tuple(r[f"last_{c}"] for c in group)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, state in zip(batch.column("path").to_pylist(), batch.column("state").to_pylist(), strict=True):
                store, path = store_of(uri)
                with store.open_input_file(path) as f:
                    t = pq.read_table(f)
                begins = starts(t)
                a, b = t.column("_la").to_numpy(), t.column("_lb").to_numpy()
                rows, second, totals = [], [], []
                for k, (x, y) in enumerate(zip(begins, np.append(begins[1:], t.num_rows), strict=True)):
                    total = state if k == 0 else 0
                    for i in range(x, y):
                        if total > most:
                            break
                        if a[i] >= 0 and total + a[i] <= most:
                            total, pick = total + a[i], False
                        elif b[i] >= 0 and total + b[i] <= most:
                            total, pick = total + b[i], True
                        else:
                            break
                        rows.append(i)
                        second.append(pick)
                        totals.append(int(total))
                got = t.take(pa.array(rows, pa.int64()))
                text = pa.compute.if_else(pa.array(second, pa.bool_()), got.column("_b").combine_chunks(), got.column("_a").combine_chunks())
                out = pa.Table.from_arrays([*(got.column(c) for c in group), got.column("id"), text, pa.array(totals, pa.int64())], [*group, "id", "text", "total"])
                yield from out.combine_chunks().to_batches()

    plan = spark.createDataFrame(begin, "path string, state int").repartition(max(1, len(begin)))
    return plan.mapInArrow(fold, "".join(f"`{c}` {kinds[c]}, " for c in group) + "id long, text string, total long")


def running_before(df: DataFrame, group: str, order: str, value: Column, to: str, width: int = 1000) -> DataFrame:
    """(group, order, to): for each distinct place of a group the sum of `value` over the rows at smaller places.

    Places are whole numbers; rows of a place are summed first, then sums run within stretches of `width` places and over the stretches, so
    that a long group is many tasks.
    """
    each = df.groupBy(group, order).agg(F.sum(value).alias("_v")).withColumn("_s", F.floor(F.col(order) / width))
    over = Window.partitionBy(group).orderBy("_s")
    sums = each.groupBy(group, "_s").agg(F.sum("_v").alias("_all")).withColumn("_base", F.sum("_all").over(over) - F.col("_all"))
    within = Window.partitionBy(group, "_s").orderBy(order)
    own = each.withColumn("_own", F.sum("_v").over(within) - F.col("_v"))
    return own.join(sums.select(group, "_s", "_base"), [group, "_s"]).select(group, order, (F.col("_own") + F.col("_base")).alias(to))
