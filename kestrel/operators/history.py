"""Trailing-window history features.

Windows are left-closed and right-open, ``[t − W, t)``: the current row and every row with the
same timestamp are excluded (quirk Q1).

One plan serves every key.  A row adds its value to the running total of its key at ``t`` and
takes it back at ``t + W``, so a trailing sum is the running sum of these moves strictly before
``t``.  Running sums are split by (key, time bucket): the totals of all earlier buckets come from
a small pre-aggregated table and enter a bucket as one more row at its start, so a single
exchange of the rows on (key, bucket) is enough and nothing is joined back.  The source is read
twice, once for the totals and once for the rows.  No task holds more than one bucket of one key,
however busy the key; null keys form a group like any other, and repeated ids are separate rows.
A row without a time has no history and adds to none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import micros

US_PER_HOUR = 3_600_000_000
US_PER_DAY = 24 * US_PER_HOUR


def _starts(totals: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per (key, bucket): the sum of ``columns`` over all earlier buckets of the key."""
    earlier = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*key, "__bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in columns])


_MESSAGE, _MOVE, _START = 1, 0, 2
TASK_BYTES = 1 << 20    # of the messages' columns by the plan's statistics (for Parquet: as stored), to one task
MOST_TASKS = 20_000


def _tasks_for(df: DataFrame) -> int | None:
    """Tasks that the events of ``df`` are dealt to; None if they fit one task, or their size is unknown.

    The number is always a fixed one: adaptive execution would merge the session's partitions into about one
    a core, so that a task grew with the table however many partitions the session has.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    found = -(-size // TASK_BYTES)
    if size >= 1 << 60 or found <= 1:
        return None
    session = df.sparkSession
    least = min(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return min(max(found, least), MOST_TASKS)


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` as it is, or exchanged on ``keys`` to so many tasks, for windows within them."""
    return df.repartition(tasks, *keys) if tasks else df


def _specs_moves(specs) -> tuple[list[dict[str, Column]], list[str]]:
    """Per spec: output name → what a row adds to it; and all output names."""
    moves = [{name: F.lit(1).cast("bigint")} | {o: F.coalesce(v.cast("bigint"), F.lit(0)) for o, v in values.items()}
             for _, values, name in specs]
    return moves, [o for m in moves for o in m]


def _events(t: Column, specs) -> list[Column]:
    """A row's events for all frames: its entry at ``t``, and per frame its exit at ``t + width``."""
    moves, outs = _specs_moves(specs)
    none = F.lit(0).cast("bigint")
    entry = F.struct(t.alias("__t"), F.lit(_MESSAGE).alias("__kind"), *[v.alias(f"__d_{o}") for m in moves for o, v in m.items()])
    exits = [F.struct((t + F.lit(width)).alias("__t"), F.lit(_MOVE).alias("__kind"),
                      *[(-mine[o] if o in mine else none).alias(f"__d_{o}") for o in outs])
             for (width, _, _), mine in zip(specs, moves)]
    return [entry, *exits]


def _exploded(df: DataFrame, key: Sequence[str], ts: str, specs, bucket_us: int) -> DataFrame:
    """``df`` with one row per event; exits keep the key and their deltas only."""
    _, outs = _specs_moves(specs)
    rows = df.withColumn("__e", F.explode(F.array(*_events(micros(ts), specs))))
    is_row = F.col("__e.__kind") == _MESSAGE
    return rows.filter(is_row | F.col("__e.__t").isNotNull()).select(
        *[F.col(c) if c in key else F.when(is_row, F.col(c)).alias(c) for c in df.columns],
        F.col("__e.__t"), F.col("__e.__kind"), F.floor(F.col("__e.__t") / F.lit(bucket_us)).alias("__bucket"),
        *[F.col(f"__e.__d_{o}") for o in outs])


def _trailing(rows: DataFrame, key: Sequence[str], outs: Sequence[str]) -> dict[str, Column]:
    """Trailing sums at each event: everything strictly before its time."""
    before = Window.partitionBy(*key, "__bucket").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    return {o: F.when(F.col("__t").isNull(), F.lit(0))
            .otherwise(F.coalesce(F.sum(f"__d_{o}").over(before), F.lit(0))).cast("bigint") for o in outs}


def _span(specs, bucket_us: int) -> int:
    """The bucket width: ``bucket_us``, or a smaller one that every frame's width is a multiple of."""
    return math.gcd(bucket_us, *[width for width, _, _ in specs])


def trailing_counts_multi(df: DataFrame, key: str | Sequence[str], ts: str,
                          specs: Sequence[tuple[int, dict[str, Column], str]], *,
                          bucket_us: int = US_PER_DAY) -> DataFrame:
    """Several trailing frames over one key in one pass: ``specs`` = [(width_us, values, count_name), ...].

    Appends per spec the number of rows in ``[ts − width, ts)`` and the sums of ``values`` there.  A frame
    is a whole number of buckets, so what it holds at the start of a bucket is the sum over that many
    earlier buckets; inside the bucket, entries and exits do the rest.
    """
    key = [key] if isinstance(key, str) else list(key)
    moves, outs = _specs_moves(specs)
    bucket_us = _span(specs, bucket_us)
    rows = _exploded(df, key, ts, specs, bucket_us)
    per = (df.withColumn("__bucket", F.floor(micros(ts) / F.lit(bucket_us))).filter(F.col("__bucket").isNotNull())
           .groupBy(*key, "__bucket").agg(*[F.sum(v).alias(f"__d_{o}") for m in moves for o, v in m.items()]))
    along = Window.partitionBy(*key).orderBy("__bucket")
    starts = per.select(*key, "__bucket", *[
        F.coalesce(F.sum(f"__d_{o}").over(along.rangeBetween(-(width // bucket_us), -1)), F.lit(0)).alias(f"__d_{o}")
        for (width, _, _), m in zip(specs, moves) for o in m]).withColumns(
        {"__t": F.col("__bucket") * F.lit(bucket_us) - F.lit(1), "__kind": F.lit(_START)})
    both = rows.unionByName(starts, allowMissingColumns=True)
    return (both.withColumns(_trailing(both, key, outs)).filter(F.col("__kind") == _MESSAGE).select(*df.columns, *outs))


def trailing_counts(df: DataFrame, key: str | Sequence[str], ts: str, width_us: int,
                    values: dict[str, Column], count_name: str, *, bucket_us: int = US_PER_HOUR) -> DataFrame:
    """Append ``count_name`` = rows in ``[ts − width, ts)`` and ``values`` summed over the same frame."""
    return trailing_counts_multi(df, key, ts, [(width_us, values, count_name)], bucket_us=bucket_us)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


_USER, _CHANNEL, _PAIR = 0, 1, 2


def _history_starts(msgs: DataFrame, user: str, channel: str, ts: str, lab: Column, days: Sequence[int]):
    """What each day of each key starts with, for all three kinds of key.

    One aggregate over the rows and one window over its few rows serve all kinds.  Returns
    ``of(kind)``: (__key, __key2, __bucket, __last, __n, and __n<d>, __bad<d> for the last d of ``days`` days).
    """
    def tagged(kind, key, key2):
        return F.struct(F.lit(kind).alias("__of"), key.alias("__key"), key2.alias("__key2"))
    u, c = F.col(user), F.col(channel)
    no_user, no_channel = (F.lit(None).cast(msgs.schema[k].dataType) for k in (user, channel))
    keys = F.array(tagged(_USER, u, no_channel), tagged(_CHANNEL, no_user, c), tagged(_PAIR, u, c))
    e = msgs.select(micros(ts).alias("__t"), lab.alias("__bad"), F.explode(keys).alias("k")).select("k.*", "__t", "__bad")
    per = e.withColumn("__bucket", F.floor(F.col("__t") / F.lit(US_PER_DAY))).groupBy("__of", "__key", "__key2", "__bucket").agg(
        F.max("__of").alias("__is"), F.max("__t").alias("__last"), F.count(F.lit(1)).alias("__n"),
        F.sum(F.coalesce("__bad", F.lit(0))).alias("__bad"))
    along = Window.partitionBy("__of", "__key", "__key2").orderBy("__bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    found = per.select("__is", "__key", "__key2", "__bucket", F.max("__last").over(earlier).alias("__last"),
                       F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"),
                       *[F.coalesce(F.sum(x).over(along.rangeBetween(-d, -1)), F.lit(0)).alias(f"{x}{d}") for d in days for x in ("__n", "__bad")])
    # The kind is taken from an aggregate, and every kind refers to all sums: so the aggregate and its exchanges are
    # the same for all three, and Spark runs them once.  A bucket that starts with nothing needs no row.
    read = F.greatest("__n", *[f"{x}{d}" for d in days for x in ("__n", "__bad")]) > 0
    return lambda kind: found.filter((F.col("__is") == kind) & (read | F.col("__last").isNotNull()))


def user_channel_features(msgs: DataFrame, *, user: str = "user_id", channel: str = "channel_id",
                          ts: str = "ts", label: str = "label", id_col: str = "msg_id",
                          default_gap_hours: float = 24.0, new_to_channel_max: int = 3) -> DataFrame:
    """H1–H8: the complete per-message history feature set.

    The totals of all keys (user, channel, user in channel) are one small table.  The rows are
    exchanged twice, on (user, day) for both user frames, the previous time and the running number in the
    channel, and on (channel, day) for the channel frame, to as many tasks as their size asks for.  The first
    two share one sort; the exits of frames are gone before the next.  Missing values become 0 only at the end (Q2).
    """
    tasks = _tasks_for(msgs)
    lab = F.col(label).cast("bigint")
    by_user = [(7 * US_PER_DAY, {"user_7d_bad_count": lab}, "user_7d_msg_count"),
               (30 * US_PER_DAY, {"user_30d_bad_count": lab}, "user_30d_msg_count")]
    by_channel = [(US_PER_DAY, {"channel_24h_bad_count": lab}, "channel_24h_msg_count")]
    user_outs, channel_outs = _specs_moves(by_user)[1], _specs_moves(by_channel)[1]
    tsu = micros(ts)
    of = _history_starts(msgs, user, channel, ts, lab, (1, 7, 30))
    begin = {"__t": F.col("__bucket") * F.lit(US_PER_DAY) - F.lit(1), "__kind": F.lit(_START)}

    def held(specs) -> list[Column]:
        """Start columns of the frames, under the names of their deltas."""
        return [F.col(f"{x}{width // US_PER_DAY}").alias(f"__d_{o}")
                for width, values, name in specs for x, o in zip(("__n", "__bad"), (name, *values))]

    # User pass: rows, exits, and what every (user, day) and every (user, channel, day) starts with.
    rows = _exploded(msgs, [user], ts, by_user, US_PER_DAY).withColumns(
        {"__at": F.when(F.col("__kind") == _MESSAGE, F.col("__t")), "__n": F.when(F.col("__kind") == _MESSAGE, 1).cast("bigint")})
    own = of(_USER).filter(F.col("__bucket").isNotNull()).select(
        F.col("__key").alias(user), "__bucket", F.col("__last").alias("__at"), *held(by_user)).withColumns(begin)
    pair = of(_PAIR).select(F.col("__key").alias(user), F.col("__key2").alias(channel), "__bucket", "__n").withColumns(
        begin | {"__pair": F.lit(1)})
    d = _dealt(rows.unionByName(own, allowMissingColumns=True).unionByName(pair, allowMissingColumns=True), tasks, user, "__bucket")
    in_order = Window.partitionBy(user, "__bucket").orderBy("__t", F.col("__kind").desc(), id_col)
    in_channel = (Window.partitionBy(user, "__bucket", channel).orderBy(F.col("__pair").asc_nulls_last(), ts, id_col)
                  .rowsBetween(Window.unboundedPreceding, 0))
    # The order of the first window is one that the next can use.
    d = d.withColumn("__prev_us", F.last("__at", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumns(_trailing(d, [user], user_outs)).filter(F.col("__kind") != _MOVE)
    d = d.withColumn("user_channel_msg_count", F.sum("__n").over(in_channel))
    d = d.filter(F.col("__kind") == _MESSAGE).select(*msgs.columns, *user_outs, "__prev_us", "user_channel_msg_count")

    # Channel pass.
    rows = _exploded(d, [channel], ts, by_channel, US_PER_DAY)
    own = of(_CHANNEL).filter(F.col("__bucket").isNotNull()).select(F.col("__key2").alias(channel), "__bucket", *held(by_channel)).withColumns(begin)
    columns = [*d.columns, *channel_outs]
    d = _dealt(rows.unionByName(own, allowMissingColumns=True), tasks, channel, "__bucket")
    d = d.withColumns(_trailing(d, [channel], channel_outs)).filter(F.col("__kind") == _MESSAGE).select(*columns)
    r7 = _ratio(F.col("user_7d_bad_count"), F.col("user_7d_msg_count"))
    r30 = _ratio(F.col("user_30d_bad_count"), F.col("user_30d_msg_count"))
    return d.withColumns({
        "user_msg_velocity": F.col("user_7d_msg_count") / F.lit(7.0),
        "user_bad_ratio_7d": F.coalesce(r7, F.lit(0.0)),
        "user_bad_ratio_30d": F.coalesce(r30, F.lit(0.0)),
        "user_toxicity_trend": F.coalesce(r7 - r30, F.lit(0.0)),
        "channel_toxicity_ratio": F.coalesce(
            _ratio(F.col("channel_24h_bad_count"), F.col("channel_24h_msg_count")), F.lit(0.0)),
        "hours_since_last_msg": F.coalesce((tsu - F.col("__prev_us")) / F.lit(float(US_PER_HOUR)),
                                           F.lit(float(default_gap_hours))),
        "is_new_to_channel": (F.col("user_channel_msg_count") <= new_to_channel_max).cast("int"),
    }).drop("__prev_us")


def group_stats_onto_rows(df: DataFrame, key: str, label: str = "label",
                          count_name: str = "user_msg_count", rate_name: str = "user_toxic_rate") -> DataFrame:
    """Per-key row count and mean label mapped back onto every row.

    One partial aggregate and a null-safe join, which adaptive execution splits for a busy key;
    a window would buffer all rows of the key in one task.
    """
    stats = df.groupBy(F.col(key).alias("__key")).agg(
        F.count(F.lit(1)).alias(count_name), F.avg(F.col(label).cast("double")).alias(rate_name))
    return df.join(stats, F.col(key).eqNullSafe(F.col("__key")), "inner").drop("__key")


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[tuple[Column, bool]],
                  columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key — the first under ``order`` = [(column, ascending), ...].

    Written as ``max_by(payload, sort key)`` so Spark aggregates partially on the map side:
    a key holding a third of all rows is reduced inside each map task before the shuffle and
    never lands whole in one task.  The payload is not compared, so it may hold maps.  Put a
    unique tie-break last in ``order``; rows equal on the whole key are interchangeable.
    """
    key = [key] if isinstance(key, str) else list(key)
    columns = [c for c in (columns or df.columns) if c not in key]
    d = df
    plain = {f.name for f in d.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(order)]).schema.fields
             if isinstance(f.dataType, T.NumericType)}
    parts = [c if not asc else -c if f"k{i}" in plain else None for i, (c, asc) in enumerate(order)]
    if all(p is not None for p in parts):
        sort_key = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
        best = F.max_by(F.struct(*columns), sort_key).alias("__best")
        return d.groupBy(*key).agg(best).select(*key, *[F.col(f"__best.{c}").alias(c) for c in columns])
    # A key that cannot be negated (text, time) and ascends: keep the rows that are extreme on one key after
    # another.  Each step is a partial aggregate and a null-safe join, which adaptive execution splits for a busy key.
    for c, asc in order:
        c = c.alias("__o")
        held = d.withColumn("__o", c)
        top = held.groupBy(*[F.col(k).alias(f"__k_{k}") for k in key]).agg((F.min if asc else F.max)("__o").alias("__top"))
        on = F.col("__o").eqNullSafe(F.col("__top"))
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        d = held.join(top, on, "left_semi").drop("__o")
    return d.groupBy(*key).agg(F.any_value(F.struct(*columns)).alias("__best")).select(*key, *[F.col(f"__best.{c}").alias(c) for c in columns])


def latest_per_key(df: DataFrame, key: str | Sequence[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key by ``ts``, ties broken by the larger ``tie``."""
    return first_per_key(df, key, [(micros(ts), False), (F.col(tie), False)])


def running_sum(df: DataFrame, key: Sequence[str], ts: str, tie: str, values: dict[str, str],
                bucket_us: int = US_PER_DAY, inclusive: bool = False) -> DataFrame:
    """Running sums per key in (ts, tie) order: ``out = Σ value`` over earlier rows (or up to this one)."""
    key = list(key)
    d = df.withColumns({"__bucket": F.floor(micros(ts) / F.lit(bucket_us)), "__kind": F.lit(1),
                        **{f"__x_{o}": F.col(v).cast("bigint") for o, v in values.items()}})
    xs = [f"__x_{o}" for o in values]
    totals = d.groupBy(*key, "__bucket").agg(*[F.sum(x).alias(x) for x in xs])
    both = d.unionByName(_starts(totals, key, xs).withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    local = (Window.partitionBy(*key, "__bucket").orderBy("__kind", ts, tie)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return (both.withColumns({o: F.coalesce(F.sum(f"__x_{o}").over(local), F.lit(0)) for o in values})
            .filter(F.col("__kind") == 1).select(*df.columns, *values))


def running_number(df: DataFrame, key: Sequence[str], ts: str, tie: str, out: str,
                   bucket_us: int = US_PER_DAY) -> DataFrame:
    """H8: number of the row within its key in (ts, tie) order, from 1."""
    return running_sum(df.withColumn("__one", F.lit(1)), key, ts, tie, {out: "__one"}, bucket_us, True).drop("__one")


def previous_ts_us(df: DataFrame, key: Sequence[str], ts: str, tie: str, out: str,
                   bucket_us: int = US_PER_DAY) -> DataFrame:
    """H7: event time (µs) of the previous row of the same key in (ts, tie) order; null for the first.

    A bucket starts with the latest time of the key's earlier buckets.
    """
    key = list(key)
    d = df.withColumns({"__tu": micros(ts), "__kind": F.lit(1)}).withColumn("__bucket", F.floor(F.col("__tu") / F.lit(bucket_us)))
    last = d.groupBy(*key, "__bucket").agg(F.max("__tu").alias("__tu"))
    earlier = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*key, "__bucket", F.max("__tu").over(earlier).alias("__tu"), F.lit(0).alias("__kind"))
    local = Window.partitionBy(*key, "__bucket").orderBy("__kind", ts, tie)
    return (d.unionByName(carry, allowMissingColumns=True).withColumn(out, F.lag("__tu").over(local))
            .filter(F.col("__kind") == 1).select(*df.columns, out))
