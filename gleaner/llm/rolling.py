"""Rolling window features of event series by square-root decomposition.

Of each row and each width W: how many rows its series has at times from t - W to before t, the sum of their values, how many
different labels they have, and values of given ranks. Rows of one series and time share their windows.

Time is cut into spans of the greatest width, so a window lies in the span of its row and the one before. Of a
series and span one group gets both spans' counts, already summed by time and bucket. There, instants are in blocks of about the square root
of their number; a cumulative histogram is kept at each block's start. A window's histogram is the difference of
those at two instants, each being its block's checkpoint and the events of the block before the instant. Scanning its
coarse buckets finds the one of a rank; a second group, of series, span and coarse bucket, does the same with the exact
values of that bucket. Labels are counted by their own histograms.

No group holds rows: the first has at most a cell for each instant and coarse bucket (about 130), whatever the
number of rows, the second a cell for each instant and value of its bucket. Nothing is collected or broadcast but keys of
very many equal times, whose number has a bound (common.join_counted).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted

#: Coarse buckets of values: so many for each doubling.
PER_DOUBLING = 4
#: Columns of a label histogram that are handled at once.
LABEL_COLUMNS = 1024


def coarse(value: Column) -> Column:
    """The bucket of a value of 0 or more: values below 2 * PER_DOUBLING have their own, then each doubling has PER_DOUBLING of equal width."""
    width = PER_DOUBLING.bit_length() - 1
    up = F.greatest(F.lit(0), F.length(F.regexp_replace(F.bin(value), "^0+", "")) - 1 - width)  # the leading digits after which others are dropped
    return (F.lit(PER_DOUBLING) * up + F.call_function("shiftright", value, up)).cast("int")


class Histograms:
    """Counts by column of all cells before an instant, from a checkpoint at each block of instants and the block's own cells."""

    def __init__(self, at: np.ndarray, column: np.ndarray, count: np.ndarray, instants: int, columns: int):
        self.step, self.columns = max(1, isqrt(instants)), columns
        order = np.argsort(at, kind="stable")
        self.at, self.column, self.count = at[order], column[order], count[order]
        blocks = instants // self.step + 1
        self.edge = np.searchsorted(self.at, np.arange(blocks + 1) * self.step)
        self.checkpoint = np.zeros((blocks + 1, columns), np.int64)
        np.add.at(self.checkpoint, (self.at // self.step + 1, self.column), self.count)
        np.cumsum(self.checkpoint, axis=0, out=self.checkpoint)

    def before(self, at: np.ndarray) -> np.ndarray:
        """A row of counts for each instant number (ascending)."""
        out = np.empty((len(at), self.columns), np.int64)
        block = at // self.step
        for b in np.unique(block).tolist():
            mine = slice(*np.searchsorted(block, [b, b + 1]))
            own = slice(self.edge[b], self.edge[b + 1])
            patch = np.zeros((self.step + 1, self.columns), np.int64)
            np.add.at(patch, (self.at[own] - b * self.step + 1, self.column[own]), self.count[own])
            np.cumsum(patch, axis=0, out=patch)
            out[mine] = self.checkpoint[b] + patch[at[mine] - b * self.step]
        return out

    def windows(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Histograms of the instants low to before high (both ascending), for a block of high ones at a time."""
        block = high // self.step
        for b in np.unique(block).tolist():
            mine = slice(*np.searchsorted(block, [b, b + 1]))
            yield mine, self.before(high[mine]) - self.before(low[mine])


def ranked(counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column in which the value of that rank (from 1) lies, and its rank within the column."""
    total = np.cumsum(counts, axis=1)
    column = (total < rank[:, None]).sum(axis=1)
    column = np.minimum(column, counts.shape[1] - 1)
    each = np.arange(len(rank))
    return column, rank - (total[each, column] - counts[each, column])


def _whole(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy()


#: For each rank a name and a share of the values as a fraction: number ceil(a * m / b) of m ascending values.
Ranks = tuple[tuple[str, int, int], ...]


def _first(widths: tuple[int, ...], span: int, ranks: Ranks) -> callable:
    """Of a series and span: counts, sums, numbers of labels, and of each rank the coarse bucket and the rank in it."""

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        series, here = key[0].as_py(), key[1].as_py()
        time, bucket, count, total = (_whole(cells[c], -1) for c in ("time", "bucket", "n", "total"))
        label = cells["label"].combine_chunks().dictionary_encode()
        label = label.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        instants = np.unique(time)
        at = np.searchsorted(instants, time)
        events, valued, labelled = label < 0, (label < 0) & (bucket >= 0), label >= 0
        sums = [np.concatenate([[0], np.cumsum(np.bincount(at[events], w[events], len(instants)).astype(np.int64))]) for w in (count, np.maximum(total, 0))]
        asked = np.flatnonzero(instants // span == here)
        buckets, column = np.unique(bucket[valued], return_inverse=True)
        lengths = Histograms(at[valued], column, count[valued], len(instants), len(buckets)) if len(buckets) else None
        out = []
        for width in widths:
            low = np.searchsorted(instants, instants[asked] - width)
            n, s = (c[asked] - c[low] for c in sums)
            values, labels = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
            found = np.full((len(ranks), 2, len(asked)), -1, np.int64)
            if lengths:
                for rows, counts in lengths.windows(low, asked):
                    values[rows] = m = counts.sum(axis=1)
                    for k, (_, a, b) in enumerate(ranks):
                        col, rank = ranked(counts, -(-a * m // b))
                        found[k, :, rows] = np.where(m > 0, [buckets[col], rank], -1)
            for first in range(0, label.max(initial=-1) + 1, LABEL_COLUMNS):
                mine = labelled & (label >= first) & (label < first + LABEL_COLUMNS)
                kinds = Histograms(at[mine], label[mine] - first, np.ones(mine.sum(), np.int64), len(instants), min(LABEL_COLUMNS, label.max() + 1 - first))
                for rows, counts in kinds.windows(low, asked):
                    labels[rows] += (counts > 0).sum(axis=1)
            own = sums[0][asked + 1] - sums[0][asked]
            columns = [pa.array([series] * len(asked), pa.string()), *map(pa.array, (instants[asked], np.full(len(asked), width), own, n, s, labels, values))]
            columns += [pa.array(found[k, i]) for k in range(len(ranks)) for i in range(2)]
            out.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(out)

    names = ["series", "time", "width", "own", "n_events", "total", "n_labels", "n_values"] + [f"{kind}{k}" for k in range(len(ranks)) for kind in ("bucket", "rank")]
    return run


def _second(widths: tuple[int, ...], ranks: Ranks) -> callable:
    """Of a series, span and coarse bucket: the exact values of the asked ranks. Cells have a value, questions a width."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        is_cell = rows["width"].is_null().combine_chunks()
        cells, asked = rows.filter(is_cell), rows.filter(pc.invert(is_cell)).sort_by("time")
        instants, at = np.unique(_whole(cells["time"]), return_inverse=True)
        values, column = np.unique(_whole(cells["value"]), return_inverse=True)
        counts = Histograms(at, column, _whole(cells["n"]), len(instants), len(values))
        time, width, rank = (_whole(asked[c]) for c in ("time", "width", "rank"))
        found = np.zeros(len(time), np.int64)
        for w in widths:
            mine = np.flatnonzero(width == w)
            low, high = np.searchsorted(instants, time[mine] - w), np.searchsorted(instants, time[mine])
            for part, window in counts.windows(low, high):
                found[mine[part]] = values[ranked(window, rank[mine[part]])[0]]
        return pa.Table.from_arrays([asked["series"], asked["time"], asked["width"], asked["which"], pa.array(found)], ["series", "time", "width", "which", "value"])

    return run


def features(events: DataFrame, widths: tuple[int, ...], ranks: Ranks, series_col: str, time_col: str, value_col: str, label_col: str) -> DataFrame:
    """events with window_s, n_events, total, n_labels, n_values and each rank's value: a row for each event and width.

    A window has all events of the series at times from time - window_s to before time (whole seconds). Null values count in n_events alone, null
    labels not in n_labels; null is a series of its own. An event without a time has windows of nothing. Values are whole numbers of 0 or more.
    Windows without values have null at each rank and total 0. Repeated rows count each. An empty table gives no rows. events
    mustn't have columns of the names that are added.
    """
    span = max(widths)
    scratch = Scratch(events.sparkSession, "rolling")
    named = [f"c{k}" for k in range(len(events.columns))]
    at = lambda c: F.col(named[events.columns.index(c)])
    series = F.coalesce(F.concat(F.lit("="), at(series_col).cast("string")), F.lit(""))
    rows = events.toDF(*named).select(*named, series.alias("series"), at(time_col).cast("long").alias("time"))
    timed = rows.where("time is not null").select("series", "time", at(value_col).cast("long").alias("value"), at(label_col).cast("string").alias("label"))
    cells = timed.groupBy("series", "time", "value").agg(F.count("*").alias("n"))
    cells = scratch.save(cells.withColumn("bucket", coarse(F.col("value"))), "cells")
    nothing = F.lit(None).cast("string")
    counts = cells.groupBy("series", "time", "bucket").agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("total")).withColumn("label", nothing)
    kinds = timed.where("label is not null").groupBy("series", "time", "label").agg(F.lit(0).cast("long").alias("n"))
    both = counts.unionByName(kinds.select("*", F.lit(None).cast("int").alias("bucket"), F.lit(0).cast("long").alias("total")))
    now = F.floor(F.col("time") / span)
    twice = F.explode(F.array(now, now + 1)).alias("span")
    extra = "".join(f", bucket{k} long, rank{k} long" for k in range(len(ranks)))
    schema = f"series string, time long, width long, own long, n_events long, total long, n_labels long, n_values long{extra}"
    first = both.select("*", twice).groupBy("series", "span").applyInArrow(_first(widths, span, ranks), schema)
    first = scratch.save(first, "first")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.col(f"bucket{k}").cast("int").alias("bucket"), F.col(f"rank{k}").alias("rank")) for k in range(len(ranks)))))
    null = F.lit(None).cast("long")
    questions = first.where("n_values > 0").select("series", "time", "width", now.alias("span"), each.alias("q"))
    questions = questions.select("series", "time", "span", "q.bucket", "width", "q.which", "q.rank", null.alias("value"), null.alias("n"))
    fine = cells.where("value is not null").select("series", "time", twice, "bucket", null.alias("width"), null.cast("int").alias("which"), null.alias("rank"), "value", "n")
    exact = questions.unionByName(fine).groupBy("series", "span", "bucket").applyInArrow(_second(widths, ranks), "series string, time long, width long, which int, value long")
    of_all = first.select("series", "time", "width", "own", "n_events", "total", "n_labels", "n_values", F.lit(None).cast("int").alias("which"), null.alias("value"))
    joined = of_all.unionByName(exact, allowMissingColumns=True).groupBy("series", "time", "width")
    kept = ["own", "n_events", "total", "n_labels", "n_values"]
    joined = joined.agg(*(F.max(c).alias(c) for c in kept), *(F.max(F.when(F.col("which") == k, F.col("value"))).alias(f"value{k}") for k in range(len(ranks))))
    found = F.struct(F.col("width").alias("window_s"), *kept[1:], *(F.col(f"value{k}") for k in range(len(ranks))))
    side = joined.groupBy("series", "time").agg(F.max("own").alias("own"), F.collect_list(found).alias("w"))
    side = scratch.save(side, "features")  # read twice by the join
    empty = F.array(*(F.struct(F.lit(w).cast("long").alias("window_s"), *(F.lit(0).cast("long").alias(c) for c in kept[1:]), *(null.alias(f"value{k}") for k in range(len(ranks)))) for w in widths))
    out = join_counted(rows.where("time is not null"), side, ["series", "time"], "own").select(*named, F.explode("w").alias("w"))
    out = out.unionByName(rows.where("time is null").select(*named, F.explode(empty).alias("w")))
    added = ["w.window_s", *(f"w.{c}" for c in kept[1:]), *(F.col(f"w.value{k}").alias(name) for k, (name, _, _) in enumerate(ranks))]
    return out.select(*(F.col(n).alias(c) for n, c in zip(named, events.columns, strict=True)), *added)
