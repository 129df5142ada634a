"""Ordered work over long series without one task for a whole series: ranges of the order, and what each hands on.

A range holds about WIDTH rows: its bounds come from the values of the order themselves, so it does not matter how sparse
or crowded they are. Within ranges, rows are looked at together; of a whole series only one summary row for each range is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sumforge.operators.work import written

WIDTH = 65_536


def ranged(rows: DataFrame, order: str, *, width: int = WIDTH) -> tuple[DataFrame, str]:
    """rows with a column, whose name is returned too, that numbers ranges of ascending order; nulls are before all others.

    Bounds are approximate quantiles of order (numbers, dates or times). Rows of equal order are in one range, so a value that
    very many rows have makes a large one.
    """
    kind, name = dict(rows.dtypes)[order], _free("__range", {c.lower() for c in rows.columns})
    value = F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(order) if kind == "date" else F.col(order)
    value = value.cast("double")
    n = rows.agg(F.count(order)).first()[0]
    ranges = -(-n // width)
    if ranges < 2:
        return rows.withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(0)), name
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted({*rows.agg(F.percentile_approx(value, shares, max(10_000, 20 * ranges))).first()[0]})
    found = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=f"{name}v", outputCol=name, handleInvalid="keep").transform(rows.withColumn(f"{name}v", value))
    return found.drop(f"{name}v").withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(F.col(name).cast("int"))), name


def numbered(rows: DataFrame, order: str, *, by: tuple[str, ...] = (), name: str = "at", width: int = WIDTH) -> DataFrame:
    """rows with name, their number from 0 in ascending order, within each value of by."""
    columns = rows.columns
    rows, here = ranged(rows, order, width=width)
    n, k, so_far = (_free(c, {c.lower() for c in rows.columns}) for c in ("__n", "__k", "__before"))
    keys = [*by, here]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(here)) - F.col(n)
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    found = _joined(rows.withColumn(k, within), counts.withColumn(so_far, before).drop(n), keys)
    return found.select(*columns, (F.col(k) + F.col(so_far) - 1).cast("long").alias(name))


def running(rows: DataFrame, order: str, value: str, *, of, merge, by: tuple[str, ...] = (), name: str = "so_far", width: int = WIDTH) -> DataFrame:
    """rows with name: the aggregate of (F.sum, F.min, F.max) of value over all rows up to each; merge joins two of its values."""
    columns = rows.columns
    rows, part = ranged(rows, order, width=width)
    whole, local, before = (_free(c, {c.lower() for c in rows.columns}) for c in ("__whole", "__here", "__carry"))
    keys = [*by, part]
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(of(value).alias(whole)).withColumn(before, of(whole).over(earlier)).drop(whole)
    here, carry = F.col(local), F.col(before)
    found = _joined(rows.withColumn(local, of(value).over(upto)), totals, keys)
    total: Column = F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(merge(here, carry))
    return found.select(*columns, total.alias(name))


def with_halo(rows: DataFrame, order: str, halo: int, *, by: tuple[str, ...] = (), width: int = WIDTH) -> tuple[DataFrame, str, str]:
    """rows in ranges of exactly width, each with the first halo rows of the next; names of the range and of the flag of a row's own one.

    So a frame of up to halo rows after each row is whole within the range. Ranges are at least as long as the halo.
    """
    taken = {c.lower() for c in rows.columns}
    at, part, own = (_free(c, taken) for c in ("__at", "__part", "__own"))
    width = max(width, halo, 1)
    found = numbered(rows, order, by=by, name=at, width=width)
    mine = F.floor(F.col(at) / width)
    lent = (F.col(at) % width < halo) & (mine > 0)
    places = F.explode(F.when(lent, F.array(mine, mine - 1)).otherwise(F.array(mine)))
    return found.withColumn(part, places).withColumn(own, F.col(part) == mine).drop(at), part, own


def _joined(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what others has for their keys; null keys meet."""
    names = [_free(f"__{k}", {c.lower() for c in (*rows.columns, *others.columns)}) for k in keys]
    others = others.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return rows.join(others, on).drop(*names)


def _free(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def _wrapped(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def _changes(values: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it, from the second on; nulls are equal."""
    here, before = values.slice(1), values.slice(0, len(values) - 1)
    differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    return differ | (here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))


def scanned(rows: DataFrame, by: list[str], order: list[str], sums: list[str] = (), *, near: list[Column] | None = None, at: str = "at", partitions: int | None = None) -> DataFrame:
    """rows with at, their number from 1 in ascending order within each value of by; the long columns sums become running ones.

    The rows are dealt out by ranges of (by, order), with bounds that Spark samples, so it does not matter how the values
    lie, and a value of by with a third of all rows is spread over a third of the tasks. Each range is scanned by itself and
    written; of each range, one row (its first and last key and the totals of the last) comes to the driver, which adds up
    what every range gets from those before. Sums wrap around at 64 bits. Nulls come first, in by and in order; rows that
    are equal in all of them are numbered in any order. near: shorter columns that order the rows as order does, but for
    ties, for the bounds (order by default): rows equal in these share a task.
    """
    n, taken = len(by), {c.lower() for c in rows.columns}
    part, seq = (_free(c, taken) for c in ("__part", "__seq"))
    dealt = [*by, *(near if near is not None else order)]
    laid = rows.repartitionByRange(partitions, *dealt) if partitions else rows.repartitionByRange(*dealt)
    laid = laid.sortWithinPartitions(*by, *order)
    places = [rows.columns.index(c) for c in by], [rows.columns.index(c) for c in sums]
    schema = StructType([*rows.schema.fields, StructField(part, IntegerType()), StructField(seq, LongType()), StructField(at, LongType())])

    def local(batches):
        here, done, last, before, totals = TaskContext.get().partitionId(), 0, None, 0, [0] * len(sums)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = [batch.column(k) for k in places[0]]
            new = np.zeros(size, bool)
            for k in keys:
                new[1:] |= _changes(k)
            new[0] = done == 0 or tuple(k[0].as_py() for k in keys) != last
            index = np.arange(size)
            start = np.maximum.accumulate(np.where(new, index, -1))
            number = np.where(start < 0, before + index + 1, index - start + 1)
            columns = list(batch.columns)
            for j, k in enumerate(places[1]):
                values = columns[k].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(values)
                scan = upto - np.where(start > 0, upto[np.maximum(start - 1, 0)], 0) + np.where(start < 0, np.int64(totals[j]), 0)
                totals[j] = scan[-1]
                columns[k] = pa.array(scan)
            last, before = tuple(k[-1].as_py() for k in keys), int(number[-1])
            columns += [pa.array(np.full(size, here, np.int32)), pa.array(np.arange(done, done + size)), pa.array(number)]
            done += size
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    found = written(laid.mapInArrow(local, schema), "ranges")
    key = F.struct(*by) if n else F.lit(0)
    ends = found.groupBy(part).agg(F.min_by(key, seq).alias("first"), F.max_by(F.struct(key.alias("key"), F.col(at).alias("at"), *(F.col(c).alias(f"s{j}") for j, c in enumerate(sums))), seq).alias("last"))
    carries, open_key, so_far = {}, None, None
    for row in ends.orderBy(part).collect():  # one for each range
        first, last = tuple(row["first"]) if n else (), tuple(row["last"]["key"]) if n else ()
        values = [row["last"]["at"], *(row["last"][f"s{j}"] for j in range(len(sums)))]
        if so_far is not None and first == open_key:
            carries[row[part]] = so_far
            if last == first:
                values = [values[0] + so_far[0], *(_wrapped(a + b) for a, b in zip(values[1:], so_far[1:], strict=True))]
        open_key, so_far = last, values

    width = len(rows.columns)

    def carried(batches):
        for batch in batches:
            columns = list(batch.columns)[:width]
            parts, sequence, number = (batch.column(width + k).to_numpy() for k in range(3))
            number, scans = number.copy(), {k: columns[k].to_numpy().copy() for k in places[1]}
            for p in np.unique(parts):
                if carry := carries.get(int(p)):
                    here = (parts == p) & (number == sequence + 1)  # rows of the key that the range begins with
                    number[here] += carry[0]
                    for k, more in zip(places[1], carry[1:], strict=True):
                        scans[k][here] += np.int64(more)
            for k, values in scans.items():
                columns[k] = pa.array(values)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number)], out.names)

    out = StructType([*rows.schema.fields, StructField(at, LongType())])
    return found.mapInArrow(carried, out)
