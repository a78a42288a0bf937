"""Latency, error and health statistics, rolling frames and state replays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusweir.operators.ordering import floor_percentiles, prefix_sums
from corpusweir.operators.topk import top_k

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_summary(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float] | None = None):
    """Count, min, max, mean and percentiles per key."""
    basic = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("avg"),
    )
    return basic.join(floor_percentiles(df, keys, value, points or PERCENTILES), list(keys))


def benchmark_summary(runs: DataFrame, keys: Sequence[str], seconds: str, failed: Column) -> DataFrame:
    """Mean and p95 latency with the success rate."""
    basic = runs.groupBy(*keys).agg(
        F.avg(seconds).alias("avg_latency"), F.avg((~failed).cast("double")).alias("success_rate"),
        F.count("*").alias("runs"),
    )
    return basic.join(floor_percentiles(runs, keys, seconds, {"p95_latency": 0.95}), list(keys))


def performance_score(avg_ms: Column, success_rate: Column, target_ms: float = 1000.0) -> Column:
    """60 % latency against the target, 40 % success."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(target_ms) / F.nullif(avg_ms, F.lit(0.0)))) * 0.6 + success_rate * 0.4


def error_summary(errors: DataFrame, dims: Sequence[str] = ("component", "error_type", "severity")) -> DataFrame:
    """Counts by each dimension and in total, in one pass."""
    grouped = errors.select(*dims).groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims])
    out = grouped.agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    full = (1 << len(dims)) - 1
    label = F.coalesce(*[
        F.when(F.col("_g") == full ^ (1 << (len(dims) - 1 - i)), F.lit(d)) for i, d in enumerate(dims)
    ], F.lit("total"))
    return out.select(label.alias("dimension"),
                      F.coalesce(*[F.col(d).cast("string") for d in dims], F.lit("")).alias("value"), "n")


def system_status(components: DataFrame) -> DataFrame:
    """Overall status and how many components are in each (one row)."""
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("unhealthy", "degraded", "healthy")}
    agg = components.agg(*counts.values(), F.count("*").alias("components"))
    overall = (
        F.when(F.col("unhealthy") > 0, "unhealthy").when(F.col("degraded") > 0, "degraded")
        .when(F.col("healthy") > 0, "healthy").otherwise("unknown")
    )
    return agg.withColumn("overall_status", overall)


def health_from_rates(df: DataFrame, key: str, failed: Column, degraded: float = 0.1, unhealthy: float = 0.5):
    """Component status from its failure rate."""
    rates = df.groupBy(key).agg(F.avg(failed.cast("double")).alias("failure_rate"))
    return rates.withColumn("status", F.when(F.col("failure_rate") >= unhealthy, "unhealthy")
                            .when(F.col("failure_rate") >= degraded, "degraded").otherwise("healthy"))


def field_times(df: DataFrame, key: str, seconds: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("searches"), F.min(seconds).alias("min_time"), F.avg(seconds).alias("avg_time"),
        F.max(seconds).alias("max_time"),
    )


def hit_rates(df: DataFrame, key: str, hit: Column) -> DataFrame:
    return df.groupBy(key).agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
        F.avg(hit.cast("double")).alias("hit_rate"),
    )


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per key."""
    return top_k(df, keys, order, n, "age_rank")


def since(df: DataFrame, ts: str, now: Column, seconds: int) -> DataFrame:
    """Rows of the last ``seconds`` before ``now``."""
    return df.filter(F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - seconds * 1_000_000)


def rolling(df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Count, mean and maximum of the trailing ``seconds`` at every row.

    Time is cut into slices as long as the frame, so a frame is the end of one slice and the
    beginning of the next.  Beginnings are running aggregates of a slice; ends are running
    aggregates of the slice before, from its last row backwards, read at the time where the
    frame starts.  Each row is visited twice, however many rows a frame holds.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    sliced = df.withColumn("_us", micros).withColumn("_own", F.floor(F.col("_us") / span)).withColumn(
        "_slice", F.explode(F.array("_own", F.col("_own") + 1))
    )
    # In the next slice a row stands at its own time, in its own slice where its frame starts.
    earlier = F.col("_slice") > F.col("_own")
    sliced = sliced.withColumn("_at", F.when(earlier, F.col("_us")).otherwise(F.col("_us") - span))
    running = Window.unboundedPreceding, Window.currentRow
    end = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_at")).rangeBetween(*running)
    begin = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(*running)
    seen = {"n": F.count_if, "s": lambda c: F.sum(F.when(c, F.col(value))), "k": lambda c: F.count(F.when(c, F.col(value))),
            "m": lambda c: F.max(F.when(c, F.col(value)))}
    out = sliced.withColumns({f"_{x}_end": f(earlier).over(end) for x, f in seen.items()})
    out = out.withColumns({f"_{x}_begin": f(~earlier).over(begin) for x, f in seen.items()}).filter("_slice = _own")
    total = {x: F.coalesce(f"_{x}_end", F.lit(0)) + F.coalesce(f"_{x}_begin", F.lit(0)) for x in "nsk"}
    return out.withColumns({
        "rolling_count": total["n"], "rolling_avg": total["s"] / F.nullif(total["k"], F.lit(0)),
        "rolling_max": F.greatest("_m_end", "_m_begin"),
    }).drop("_us", "_own", "_slice", "_at", *[f"_{x}_{part}" for x in seen for part in ("end", "begin")])


def configuration_scores(runs: DataFrame, config: str, latency: str, failed: Column, target: float = 1000.0) -> DataFrame:
    """Configurations by 60 % latency and 40 % success, best first.

    The latency part is what is left of the target after the mean of the calls that
    succeeded, never below zero; without any such call the score is zero.
    """
    agg = runs.groupBy(config).agg(
        F.avg(F.when(~failed, F.col(latency))).alias("avg_latency"), F.avg((~failed).cast("double")).alias("success_rate")
    )
    latency_part = F.greatest(F.lit(0.0), (F.lit(target) - F.col("avg_latency")) / F.lit(target))
    scored = agg.withColumn("score", F.coalesce((latency_part * 0.6 + F.col("success_rate") * 0.4) * 100, F.lit(0.0)))
    # One row per configuration.
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), config)).cast("long"))


def dashboard(latency: DataFrame, errors: DataFrame, health: DataFrame) -> DataFrame:
    """Health, errors and latency as one long table (section, name, metric, value)."""
    parts = [
        health.select(F.lit("health").alias("section"), F.col("status").alias("name"),
                      F.lit("components").alias("metric"), F.col("n").cast("double").alias("value")),
        errors.select(F.lit("errors").alias("section"), F.concat_ws(":", "dimension", "value").alias("name"),
                      F.lit("count").alias("metric"), F.col("n").cast("double").alias("value")),
        latency.select(F.lit("latency").alias("section"), F.col("component").alias("name"), F.explode(
            F.create_map(*[x for m in ("count", "avg", "p95") for x in (F.lit(m), F.col(m).cast("double"))])
        ).alias("metric", "value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------- circuit breaker

BREAKER_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()), T.StructField("failure_count", T.LongType()),
    T.StructField("admitted", T.BooleanType()),
])


def breaker_step(state: tuple[str, int, float], at: float, failed: bool, threshold: int, timeout: float):
    """One call: rejected while open, tried again after the timeout."""
    name, count, last = state
    if name == "open":
        if at - last < timeout:
            return state, False
        name = "half_open"
    if not failed:
        return ("closed", 0, last), True
    count += 1
    return ("open" if count >= threshold else name, count, at), True


def replay_breaker(calls: DataFrame, keys: Sequence[str], ts: str, tie: str, failed: str,
                   threshold: int = 5, timeout: float = 60.0) -> DataFrame:
    """State after every call, in order per key.

    A success that comes at least ``timeout`` after the previous call is always
    admitted and always closes the breaker, so the history is cut there into
    episodes that do not depend on each other.  Episodes, not keys, are what is
    spread over tasks, and a task streams through them in sorted order with one
    state in memory.
    """
    keys = list(keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    spans = with_previous(calls.withColumn("_us", us), keys, "_us", tie)
    calm = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= int(timeout * 1_000_000))
    marked = spans.withColumn("_cut", (calm & ~F.col(failed)).cast("long"))
    episodes = prefix_sums(marked, keys, [F.col("_us"), F.col(tie)], {"_episode": "_cut"})
    schema = T.StructType([*calls.schema.fields, *BREAKER_SCHEMA.fields])
    names = calls.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, ("closed", 0, 0.0)
        for pdf in batches:
            rows = []
            for key, at, bad in zip(pdf[[*keys, "_episode"]].itertuples(index=False, name=None),
                                    pdf["_us"], pdf[failed], strict=True):
                if key != current:
                    current, state = key, ("closed", 0, 0.0)
                state, admitted = breaker_step(state, at / 1e6, bool(bad), threshold, timeout)
                rows.append((state[0], state[1], admitted))
            out = pd.DataFrame(rows, columns=BREAKER_SCHEMA.names, index=pdf.index)
            yield pd.concat([pdf[names], out], axis=1)

    spread = episodes.repartition(*keys, "_episode")
    return spread.sortWithinPartitions(*keys, "_episode", "_us", tie).mapInPandas(run, schema)


def with_previous(df: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """``_prev``: the ordering value of the preceding row of the key.

    Positions come from the scaled numbering, and neighbours meet in an equi
    join on (key, position), so a hot key is spread over all tasks.
    """
    from corpusweir.operators.ordering import positions
    from corpusweir.session import checkpointed

    placed = checkpointed(positions(df, list(keys), [F.col(order), F.col(tie)], "_pos"))
    before = placed.select(*keys, (F.col("_pos") + 1).alias("_pos"), F.col(order).alias("_prev"))
    return placed.join(before, [*keys, "_pos"], "left").drop("_pos")


# ------------------------------------------------------------------- progress


def progress_replay(messages: DataFrame, key: str, ts: str, tie: str, terminal: Column,
                    heartbeat: int = 30, timeout: int = 300) -> DataFrame:
    """What a listener per key would have been sent.

    Messages are relayed up to and including the first terminal one, unless a
    silence of ``timeout`` seconds ends the stream before; every full
    ``heartbeat`` of silence sends a heartbeat.  The end of a key is an
    aggregate, so no key is gathered.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = with_previous(messages.withColumn("_us", us).withColumn("_terminal", terminal), [key], "_us", tie)
    silence = F.coalesce((F.col("_us") - F.col("_prev")) / 1_000_000, F.lit(0.0))
    timed = rows.withColumn("_silence", silence)
    late = F.col("_silence") >= timeout
    stops = timed.groupBy(key).agg(
        F.min(F.when(late, F.struct("_us", tie))).alias("_late"),
        F.min(F.when(F.col("_terminal"), F.struct("_us", tie))).alias("_end"),
    )
    at = F.struct("_us", tie)
    joined = timed.join(stops, key)
    beats = F.floor(F.least(F.col("_silence"), F.lit(float(timeout))) / heartbeat)
    seen = joined.filter(
        (F.col("_end").isNull() | (at <= F.col("_end"))) & (F.col("_late").isNull() | (at <= F.col("_late")))
    )
    relayed = F.col("_late").isNull() | (at < F.col("_late"))
    return seen.groupBy(key).agg(
        F.count_if(relayed).alias("relayed"), F.sum(beats).cast("long").alias("heartbeats"),
        F.max(F.when(~relayed, "timeout").when(F.col("_terminal"), "finished").otherwise("")).alias("ended"),
    ).withColumn("ended", F.when(F.col("ended") == "", "open").otherwise(F.col("ended")))


def expired(sessions: DataFrame, created: str, now: Column, max_age: int = 3600) -> DataFrame:
    """Sessions older than ``max_age`` seconds since their creation."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))
    return sessions.filter(age > max_age * 1_000_000)
