"""The usage ledger: events to daily rollups, summaries, trends, streaks, milestones, costs and stages.

Days are event-time UTC dates. Events whose tokens are not positive or whose provider is blank are no ledger events.
Everything after the rollup works on day x provider x model rows, a small table next to the events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.functions import pricing as P

#: Summary ranges in days; `all` has none.
RANGES = {"day": 1, "week": 7, "month": 30, "year": 365, "all": None}
STATUSES = ("completed", "stopped", "tool-call-turn")
#: The ledger's view of the driver's events, by user_id, k and event_type.
PROVIDERS = ("ollama", "unsloth", "openai", "anthropic", "deepseek")
MODELS = {
    "ollama": ("llama3", "marco-o1", "qwen3"), "unsloth": ("default", "mistral", "phi"), "openai": ("gpt-4o", "gpt-4o-mini", "o1-mini"),
    "anthropic": ("claude-3-5-sonnet-20241022", "claude-3-5-haiku-20241022", "claude-3-opus-20240229"), "deepseek": ("deepseek-flash", "deepseek-v4-pro", "deepseek-chat"),
}
STATUS_OF = {"purchase": "completed", "click": "completed", "view": "stopped", "signup": "tool-call-turn", "error": "unknown"}


def from_events(events: DataFrame) -> DataFrame:
    """The driver's `events` as usage events, by integer arithmetic only."""
    k = F.get_json_object("props", "$.k").cast("long")
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("user_id") % 5 + 1).cast("int"))
    model = F.lit(None).cast("string")
    for name, own in MODELS.items():
        model = F.when(F.col("provider") == name, F.element_at(F.array(*map(F.lit, own)), (F.col("k") % 3 + 1).cast("int"))).otherwise(model)
    status = F.lit(None).cast("string")
    for kind, said in STATUS_OF.items():
        status = F.when(F.col("event_type") == kind, said).otherwise(status)
    out = events.withColumn("k", k).withColumn("provider", provider)
    return out.select(
        "event_id", "ts", F.to_date("ts").alias("day"), "provider", model.alias("model"), F.floor(F.col("value") * 10).cast("long").alias("prompt"), (F.col("k") * 5).alias("completion"),
        F.floor(F.floor(F.col("value") * 10) / 4).cast("long").alias("cached"), status.alias("status"), (F.col("event_id") % 2 == 0).alias("exact"), F.col("provider").isin(*P.LOCAL_PROVIDERS).alias("local"),
    )


def cleaned(events: DataFrame) -> DataFrame:
    """Events of the ledger: counts not negative, known statuses, a positive total and a provider."""
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("completed")
    out = events.withColumn("prompt", count("prompt")).withColumn("completion", count("completion")).withColumn("cached", count("cached")).withColumn("status", status)
    return out.withColumn("total", F.col("prompt") + F.col("completion")).where((F.col("total") > 0) & (F.coalesce(F.trim("provider"), F.lit("")) != ""))


def _if(cond: str | Column, value: str = "total") -> Column:
    return F.sum(F.when(F.expr(cond) if isinstance(cond, str) else cond, F.col(value)).otherwise(0))


def daily(events: DataFrame, *more: str) -> DataFrame:
    """AGG-01/02/04: the rollup by day and provider, and by the columns in `more`."""
    e = cleaned(events).withColumn("peak", (F.col("provider") == "deepseek") & P.is_peak(F.col("ts"))).withColumn("off", (F.col("provider") == "deepseek") & ~P.is_peak(F.col("ts")))
    return e.groupBy("day", "provider", *more).agg(
        F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cached").alias("cached_hit"), F.sum("total").alias("total"),
        _if("exact").alias("exact"), _if("not coalesce(exact, false)").alias("estimated"), _if("local").alias("local_tokens"), _if("not coalesce(local, false)").alias("remote_tokens"), F.count("*").alias("events"),
        _if("peak", "prompt").alias("peak_prompt"), _if("peak", "completion").alias("peak_completion"), _if("peak", "cached").alias("peak_hit"),
        _if("off", "prompt").alias("off_prompt"), _if("off", "completion").alias("off_completion"), _if("off", "cached").alias("off_hit"),
    )


def status_pivot(events: DataFrame) -> DataFrame:
    """AGG-03: a column for each known status; unknown ones count as completed."""
    wide = cleaned(events).groupBy("day").pivot("status", list(STATUSES)).count()
    return wide.select("day", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s.replace("-", "_")) for s in STATUSES])


def _today(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.max("day").alias("today"))


def _ranges(rollup: DataFrame) -> DataFrame:
    """The ranges as a dimension of five rows: name, first day, first and last day of the period before."""
    rows = [(k, n) for k, n in RANGES.items()]
    dim = rollup.sparkSession.createDataFrame(rows, "range_key string, days int")
    day = lambda n: F.date_sub("today", n)
    return F.broadcast(dim.crossJoin(_today(rollup)).select("range_key", "days", "today", day(F.col("days") - 1).alias("since"), day(F.col("days") * 2 - 1).alias("before"), day(F.col("days")).alias("until")))


def summary_ranges(rollup: DataFrame) -> DataFrame:
    """AGG-05/06/07/08: all five ranges at once, from day x provider rows; ranges nest, so a row joins those that hold it."""
    r = _ranges(rollup)
    days = rollup.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("total", "prompt", "completion", "exact", "local_tokens", "events")])
    met = days.join(r, F.col("since").isNull() | (F.col("day") >= F.least("since", "before")))
    now, old = F.col("since").isNull() | (F.col("day") >= F.col("since")), F.col("day").between(F.col("before"), F.col("until"))
    out = met.groupBy("range_key").agg(
        *[F.sum(F.when(now, F.col(c)).otherwise(0)).alias(c) for c in ("total", "prompt", "completion", "exact", "local_tokens", "events")],
        F.sum(F.when(now & (F.col("total") > 0), 1).otherwise(0)).alias("active_days"),
        F.max(F.when(now, F.struct(F.col("total"), (-F.unix_date("day")).alias("o"), F.col("day")))).alias("top"),
        F.sum(F.when(old, F.col("total")).otherwise(0)).alias("previous_total"), F.sum(F.when(old, F.col("local_tokens")).otherwise(0)).alias("previous_local"),
        F.sum(F.when(F.col("day") == F.col("today"), F.col("total")).otherwise(0)).alias("today_tokens"),
    )
    average = F.floor(F.try_divide("total", "active_days") + 0.5).cast("long")
    share = F.try_divide("local_tokens", "total")
    return out.select(
        "range_key", "total", "prompt", "completion", "exact", "local_tokens", "events", "active_days", F.col("top.day").alias("most_active_day"), F.coalesce(share, F.lit(0.0)).alias("local_share"), "previous_total",
        F.when(F.col("previous_total") > 0, (F.col("total") - F.col("previous_total")) / F.col("previous_total")).alias("token_trend"),
        F.when(F.col("previous_total") > 0, F.coalesce(share, F.lit(0.0)) - F.col("previous_local") / F.col("previous_total")).alias("local_share_trend"),
        "today_tokens", F.coalesce(average, F.lit(0)).alias("daily_average"), F.try_divide(F.col("today_tokens") - average, average).alias("today_vs_average"),
    )


def shares(rollup: DataFrame, *keys: str, top: int | None = None) -> DataFrame:
    """WIN-02, TOP-07: totals by `keys`, their share of all and their rank; ties by the keys."""
    own = rollup.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("events").alias("events"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = own.withColumn("share", F.col("total") / F.sum("total").over(every)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), *keys)))
    return out if top is None else out.where(F.col("rank") <= top)


def timeline(rollup: DataFrame, days: int = 14) -> DataFrame:
    """WIN-03, AGG-26: the last `days` days with zeros filled in, and bar heights for a height of 100."""
    spine = _today(rollup).select(F.explode(F.sequence(F.date_sub("today", days - 1), F.col("today"))).alias("day"))
    own = rollup.groupBy("day").agg(F.sum("total").alias("total"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = spine.join(own, "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"))
    return out.withColumn("bar", F.greatest(F.lit(3), F.floor(F.col("total") / F.greatest(F.max("total").over(every), F.lit(1)) * 100 + 0.5)).cast("long"))


def local_streak(rollup: DataFrame) -> DataFrame:
    """WIN-04: days in a row, up to today, with local tokens; gaps and islands over active days."""
    days = rollup.groupBy("day").agg(F.sum("local_tokens").alias("n")).where("n > 0")
    island = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))
    runs = island.groupBy("island").agg(F.max("day").alias("last"), F.count("*").alias("streak"))
    return _today(rollup).join(F.broadcast(runs), F.col("last") == F.col("today"), "left").select("today", F.coalesce("streak", F.lit(0)).alias("local_streak"))


def milestones(rollup: DataFrame) -> DataFrame:
    """AGG-09: the five milestones of all time."""
    d = rollup.groupBy("day").agg(F.sum("total").alias("total"), F.sum("local_tokens").alias("local"))
    t = d.agg(F.sum("total").alias("total"), F.sum("local").alias("local"), F.sum((F.col("total") > 0).cast("int")).alias("days"))
    return t.select(F.expr("stack(5, 'first-reply', total > 0, 'local-seed', local > 0, 'local-10k', local >= 10000, 'mostly-local', total > 0 and local / total >= 0.5, 'seven-days', days >= 7) as (milestone, achieved)"))


def cost_by_model(rollup: DataFrame) -> DataFrame:
    """AGG-10: cost from each model's own prompt and completion tokens at the matched rate."""
    own = rollup.groupBy("provider", "model").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("total").alias("total"))
    priced = own.join(P.match_price(own), ["provider", "model"])
    return priced.select("provider", "model", "price_key", "prompt", "completion", P.flat_cost(F.col("prompt"), F.col("completion"), F.col("rate_in"), F.col("rate_out")).alias("cost"))


def cost_by_share(rollup: DataFrame) -> DataFrame:
    """AGG-10 as the summary has it: the global prompt and completion tokens split by each model's share of all tokens.

    The tiered provider prices its tiers at the card of its largest model and splits that by its models' totals.
    """
    own = rollup.groupBy("provider", "model").agg(*[F.sum(c).alias(c) for c in ("prompt", "completion", "total", "peak_prompt", "peak_completion", "peak_hit", "off_prompt", "off_completion", "off_hit")])
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = Window.partitionBy("provider")
    m = own.join(P.match_price(own), ["provider", "model"])
    part = F.col("total") / F.sum("total").over(every)
    split = lambda c: F.floor(F.sum(c).over(every) * part + 0.5)
    flat = P.flat_cost(split("prompt"), split("completion"), F.col("rate_in"), F.col("rate_out"))
    first = F.first("model").over(by.orderBy(F.desc("total"), "model").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = lambda c: F.sum(c).over(by)
    tiers = P.tiered_cost(first, s("peak_prompt"), s("peak_completion"), s("peak_hit"), F.lit(True)) + P.tiered_cost(first, s("off_prompt"), s("off_completion"), s("off_hit"), F.lit(False))
    tiered = (F.col("provider") == "deepseek") & (s("peak_prompt") + s("peak_completion") + s("off_prompt") + s("off_completion") > 0)
    return m.select("provider", "model", "total", F.when(tiered, tiers * F.col("total") / s("total")).otherwise(flat).alias("cost"))


def tiered_costs(events: DataFrame) -> DataFrame:
    """SCA-45 over events of the tiered provider: cost by day, model and tier."""
    e = cleaned(events).where(F.col("provider") == "deepseek").withColumn("peak", P.is_peak(F.col("ts")))
    return e.groupBy("day", "model", "peak").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cached").alias("hit")).withColumn("cost", P.tiered_cost(F.col("model"), F.col("prompt"), F.col("completion"), F.col("hit"), F.col("peak")))


def budget_progress(costs: DataFrame, budget: float, warn_percent: float = 80.0) -> DataFrame:
    """AGG-22: spent share of a budget, at most 1, and its level."""
    share = F.col("cost") / F.lit(budget)
    level = F.when(share >= 0.9, "danger").when(share >= warn_percent / 100, "warn").otherwise("ok")
    return costs.select("provider", F.col("cost"), F.least(share, F.lit(1.0)).alias("progress"), level.alias("level"))


def local_savings(rollup: DataFrame) -> DataFrame:
    return rollup.agg((F.sum("local_tokens") / 1e6 * P.SAVED_PER_MILLION).alias("local_savings"))


def store_total(days: DataFrame) -> DataFrame:
    """AGG-23: the sum of all days, and how many providers they hold; 0 without any."""
    return days.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"), F.countDistinct("provider").alias("providers"))


def xp(events: DataFrame) -> DataFrame:
    """AGG-11, SCA-47: experience, replies, first and last event and stage of each provider."""
    e = cleaned(events)
    out = e.groupBy("provider").agg(F.sum("total").alias("xp"), F.sum((F.col("status") != "tool-call-turn").cast("long")).alias("replies"), F.min("ts").alias("hatched_at"), F.max("ts").alias("last_fed_at"))
    return out.withColumn("stage", P.stage(F.col("xp"))).withColumn("progress", P.stage_progress(F.col("xp")))


def stage_ups(events: DataFrame) -> DataFrame:
    """WIN-05: one row where a provider's running total enters a later stage; the second stage is not announced.

    Running totals go through day totals first, so a window holds one day of one provider, whatever the history's length.
    """
    e = cleaned(events).select("provider", "day", "ts", "event_id", "total")
    per_day = e.groupBy("provider", "day").agg(F.sum("total").alias("d"))
    earlier = Window.partitionBy("provider").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.select("provider", "day", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("from"))
    within = Window.partitionBy("provider", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = e.withColumn("w", F.sum("total").over(within)).join(per_day, ["provider", "day"]).withColumn("after", F.col("from") + F.col("w"))
    run = run.withColumn("old", P.stage(F.col("after") - F.col("total"))).withColumn("new", P.stage(F.col("after")))
    return run.where((F.col("old") != F.col("new")) & (F.col("new") != "hatchling")).select("provider", "event_id", F.col("old").alias("from_stage"), F.col("new").alias("to_stage"), F.col("after").alias("xp"))


#: The companions of the providers.
COMPANIONS = (("ollama", "Ollie"), ("unsloth", "Slothy"), ("openai", "Sparky"), ("anthropic", "Clyde"), ("deepseek", "Pearl"))


def companions(rows: DataFrame) -> DataFrame:
    """JN-15: rows of providers with their companion's name; null for others. The dimension has five rows."""
    names = rows.sparkSession.createDataFrame(COMPANIONS, "provider string, companion string")
    return rows.join(F.broadcast(names), "provider", "left")


def stage_state(xp: Column, replies: Column, hatched: Column, fed: Column, stages: Column) -> Column:
    """SCA-69: a saved companion made sound: counts and times at least 0, known stages once each and none beyond its own."""
    count = lambda c: F.greatest(F.lit(0), F.coalesce(F.floor(c.cast("double") + 0.5), F.lit(0)).cast("long"))
    time = lambda c: F.greatest(F.lit(0), F.coalesce(F.floor(c.cast("double")), F.lit(0)).cast("long"))
    reached = F.array(*(F.when(count(xp) >= least, F.lit(key)) for least, key in P.XP_STAGES))
    held = F.array_distinct(F.filter(F.coalesce(stages, F.array().cast("array<string>")), lambda s: s.isNotNull() & F.array_contains(F.array_compact(reached), s)))
    return F.struct(count(xp).alias("xp"), count(replies).alias("replies"), time(hatched).alias("hatched_at"), time(fed).alias("last_fed_at"), held.alias("stages"))


def companion(rollup: DataFrame) -> DataFrame:
    """SCA-48: stage and mood from all time and the last month."""
    s = summary_ranges(rollup)
    pick = lambda key, c: F.max(F.when(F.col("range_key") == key, F.col(c)))
    row = s.agg(pick("all", "total").alias("total"), pick("all", "local_share").alias("all_share"), pick("month", "local_share").alias("share"), pick("month", "total").alias("recent"), pick("month", "local_share_trend").alias("trend"))
    share = F.when(F.col("recent") > 0, F.col("share")).otherwise(F.col("all_share"))
    return row.select(P.stage(F.col("total"), P.COMPANION_STAGES).alias("stage"), P.mood(F.col("total"), share, F.col("trend")).alias("mood"))


def dedup_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """STR-06 in batch: the first event of each id by time, ties by their other columns; blank ids are all kept."""
    named = events.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    order = Window.partitionBy(key).orderBy("ts", F.xxhash64(*events.columns))
    return named.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").unionByName(events.where(F.coalesce(F.col(key).cast("string"), F.lit("")) == ""))


def dedup_window(rows: DataFrame, key: str, ts: str, seconds: int = 8, tie: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """SET-07, STR-09: rows of a key that come `seconds` or more after its last row that was kept; the first is kept.

    A row that comes so long after the row before it is kept whatever was kept before, so a key's rows fall into bursts that
    are judged by themselves, in order, as they stream by: no task holds a key. Rows without a time are all kept.
    """
    marked = rows.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("at"), *(F.col(c).alias(f"tie{i}") for i, c in enumerate(tie)))
    order = Window.partitionBy("key").orderBy("at", *(f"tie{i}" for i in range(len(tie))))
    fresh = F.coalesce(F.col("at") - F.lag("at").over(order) >= seconds * 1_000_000, F.lit(True))
    bursts = marked.withColumn("fresh", fresh).withColumn("burst", F.sum(F.col("fresh").cast("int")).over(order))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for own, at in zip(zip(batch.column("key").to_pylist(), batch.column("burst").to_pylist(), strict=True), batch.column("at").to_pylist(), strict=True):
                if own != now:
                    now, last = own, None
                keep.append(at is None or last is None or at - last >= seconds * 1_000_000)
                if keep[-1] and at is not None:
                    last = at
            yield batch.select(["row"]).filter(pa.array(keep, pa.bool_()))

    dealt = bursts.repartition("key", "burst").sortWithinPartitions("key", "burst", "at", *(f"tie{i}" for i in range(len(tie))))
    return dealt.select("row", "key", "burst", "at").mapInArrow(judged, StructType([StructField("row", rows.schema)])).select("row.*")


def retained(rollup: DataFrame, days: int) -> DataFrame:
    """STR-11: the last `days` days."""
    return rollup.join(F.broadcast(_today(rollup)), F.col("day") >= F.date_sub("today", days - 1)).drop("today")
