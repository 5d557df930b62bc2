"""Ordered statistics without a task that holds a whole group: value ranges, prefix sums, percentiles.

Input is a count table: one row per distinct value of every group.  A value whose hash falls into
the lowest 1 / ``RANGE_ROWS`` of the hash space is a splitter, so the number of ranges grows with
the distinct values and a range holds about ``RANGE_ROWS`` of them; beyond ``MOST`` splitters a
group keeps those of smallest hash and its ranges grow instead.  Splitters depend on the
values alone: whichever branch of a plan computes them, or computes them again after a lost
executor, gets the same ranges.  A group's splitters travel as one array of at most ``MOST`` numbers,
broadcast; the groups of all callers (features, sides, runs) are few and known when the plan is built.

Nothing here starts a job.  Splitters, totals and rows all read the one count table.  Every
branch refers to all its counts, so that Spark sees one exchange and reuses it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS, MOST = 1 << 16, 4096
RANGE = "__range"


def _rank_in(cuts: Column, value: Column, most: int) -> Column:
    """Number of the sorted ``cuts`` below ``value``, by bisection."""
    steps = F.sequence(F.lit(1), F.lit(most.bit_length()))

    def halve(at: Column, _step: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        below = (at["lo"] < at["hi"]) & (F.get(cuts, mid) < value)
        return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"),
                        F.when(below, at["hi"]).otherwise(F.least(mid, at["hi"])).alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.when(F.size(cuts) == 0, F.lit(0)).otherwise(F.aggregate(steps, start, halve)["lo"])


def with_ranges(counts: DataFrame, by: Sequence[str], order: str, reads: Sequence[str],
                range_rows: int | None = None, most: int | None = None) -> DataFrame:
    """Append the number of each row's value range within its group (``RANGE``).

    ``reads`` names the count columns; at least one of them is positive in every row.
    """
    range_rows, most = range_rows or RANGE_ROWS, most or MOST
    place = F.shiftrightunsigned(F.xxhash64(order), 1)          # a uniform number below 2^63
    read = sum((F.col(c) for c in reads[1:]), F.col(reads[0]))
    # The condition reads the counts, so it stays above their aggregate: pushed below, it would make all rows anew.
    sample = counts.filter(F.greatest(place, -read) < F.lit((1 << 63) // range_rows)).select(*by, order, place.alias("__place"))
    first = Window.partitionBy(*by).orderBy("__place", order)
    sample = sample.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") < most)
    if not by:
        found = counts.withColumn("__cuts", sample.agg(F.sort_array(F.collect_list(order)).alias("c")).scalar())
    else:
        cuts = sample.groupBy(*by).agg(F.sort_array(F.collect_list(order)).alias("__cuts"))
        found = counts.join(F.broadcast(cuts), list(by), "left")
    return found.withColumn(RANGE, F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(
        _rank_in(F.col("__cuts"), F.col(order), most))).drop("__cuts")


def _direction(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def running_sums(counts: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str], *,
                 inclusive: bool = True, descending: bool = False, **ranges) -> DataFrame:
    """Append running sums along ``order`` within each group: ``sums`` = {new column: summed column}.

    The total of all earlier ranges enters a range as one more row ahead of it, so the rows are
    exchanged once, on (group, range), and nothing is joined back.
    """
    d = with_ranges(counts, by, order, list(dict.fromkeys(sums.values())), **ranges)
    totals = d.groupBy(*by, RANGE).agg(*[F.sum(v).alias(f"__t_{out}") for out, v in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(_direction(RANGE, descending)).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*by, RANGE, *[F.coalesce(F.sum(f"__t_{out}").over(earlier), F.lit(0)).alias(f"__v_{out}") for out in sums])
    rows = d.withColumns({f"__v_{out}": F.col(v) for out, v in sums.items()} | {"__row": F.lit(1)})
    both = rows.unionByName(heads.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    w = (Window.partitionBy(*by, RANGE).orderBy("__row", _direction(order, descending))
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = both.withColumns({out: F.sum(f"__v_{out}").over(w) for out in sums}).filter(F.col("__row") == 1)
    return out.select(*counts.columns, *sums)


def percentiles(counts: DataFrame, by: Sequence[str], value: str, n: str, probs: Sequence[float],
                reads: Sequence[str] | None = None, **ranges) -> DataFrame:
    """Exact interpolated percentiles by selection: (group, p, percentile), a row for each of ``probs``.

    A histogram over the ranges tells which of them hold the wanted ranks; only the values of
    those ranges are put in order.  At position (total - 1) * p the two neighbouring values are
    interpolated linearly.
    """
    d = with_ranges(counts, by, value, list(reads or [n]), **ranges)
    along = Window.partitionBy(*by).orderBy(RANGE)
    hist = d.groupBy(*by, RANGE).agg(F.sum(n).alias("__in"))
    hist = hist.withColumns({"__before": F.coalesce(F.sum("__in").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                             "__all": F.sum("__in").over(Window.partitionBy(*by))})
    wanted = hist.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumn("__pos", (F.col("__all") - 1) * F.col("p"))
    wanted = wanted.withColumns({"__lo": F.floor("__pos"), "__hi": F.ceil("__pos")}).filter(
        (F.col("__before") <= F.col("__hi")) & (F.col("__before") + F.col("__in") > F.col("__lo")))
    # Two neighbouring ranks lie in at most two ranges: 2 rows for each group and p.
    rows = d.join(F.broadcast(wanted.drop("__in", "__all")), [*by, RANGE])
    inside = Window.partitionBy(*by, RANGE, "p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.col("__before") + F.sum(n).over(inside))
    two = rows.groupBy(*by, "p").agg(F.min(F.when(F.col("__upto") > F.col("__lo"), F.col(value))).alias("lower"),
                                     F.min(F.when(F.col("__upto") > F.col("__hi"), F.col(value))).alias("upper"),
                                     F.first("__pos").alias("pos"))
    between = (F.ceil("pos") - F.col("pos")) * F.col("lower") + (F.col("pos") - F.floor("pos")) * F.col("upper")
    return two.select(*by, "p", F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(between).alias("percentile"))
