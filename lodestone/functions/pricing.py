"""Token prices and ledger formats as column expressions.

SCA-44/45/46/47/48, FLT-19, JN-04/05, AGG-22/25. Money is DOUBLE throughout; unknown or negative counts are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: USD per million input and output tokens of each model key.
FLAT_RATES = {
    "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4-turbo": (10.0, 30.0), "gpt-4": (30.0, 60.0), "gpt-3.5-turbo": (0.5, 1.5),
    "o1": (15.0, 60.0), "o1-mini": (1.1, 4.4), "o3-mini": (1.1, 4.4),
    "claude-3-5-sonnet-20241022": (3.0, 15.0), "claude-3-5-haiku-20241022": (0.8, 4.0), "claude-3-opus-20240229": (15.0, 75.0),
    "claude-3-sonnet-20240229": (3.0, 15.0), "claude-3-haiku-20240307": (0.25, 1.25),
    "deepseek-flash": (0.15, 0.6), "deepseek-v4-flash": (0.15, 0.6), "deepseek-v4-pro": (0.66, 1.98), "deepseek-chat": (0.27, 1.1), "deepseek-reasoner": (0.55, 2.19),
    "__local__": (0.0, 0.0),
}
#: The rate a provider's unmatched models take; others take DEFAULT_RATE.
PROVIDER_RATES = {"ollama": (0.0, 0.0), "unsloth": (0.0, 0.0), "openai": (0.15, 0.6), "anthropic": (0.8, 4.0), "deepseek": (0.15, 0.6)}
DEFAULT_RATE = (1.0, 4.0)
#: Tiered cards, USD per million: cached input, other input, output; off-peak then peak.
TIER_RATES = {
    "deepseek-flash": ((0.003, 0.15, 0.6), (0.006, 0.3, 1.2)),
    "deepseek-v4-flash": ((0.003, 0.15, 0.6), (0.006, 0.3, 1.2)),
    "deepseek-v4-pro": ((0.022, 0.66, 1.98), (0.044, 1.32, 3.96)),
}
TIER_DEFAULT = "deepseek-flash"
#: UTC hours of weekdays that are billed at peak rates, from and until.
PEAK_HOURS = ((1, 4), (6, 10))
#: Experience stages and companion stages by least tokens.
XP_STAGES = ((0, "egg"), (1, "hatchling"), (10_000, "sprout"), (100_000, "scholar"), (1_000_000, "sage"), (10_000_000, "archmage"))
COMPANION_STAGES = ((0, "egg"), (1, "hatchling"), (50_000, "sprout"), (500_000, "scholar"), (5_000_000, "sage"), (50_000_000, "archmage"))
LOCAL_PROVIDERS = ("ollama", "unsloth")
SAVED_PER_MILLION = 3.0


def is_peak(ts: Column) -> Column:
    """FLT-19: a weekday hour in one of the peak windows, UTC."""
    hour, out = F.hour(ts), F.lit(False)
    for start, end in PEAK_HOURS:
        out = out | ((hour >= start) & (hour < end))
    return F.dayofweek(ts).between(2, 6) & out


def rate_card(spark: SparkSession) -> DataFrame:
    """The flat rates as a dimension: rate_key, rate_in, rate_out."""
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in FLAT_RATES.items()], "rate_key string, rate_in double, rate_out double")


def match_price(models: DataFrame) -> DataFrame:
    """JN-04: each distinct (provider, model) with the longest rate key that its name contains, else its provider's rate.

    A theta join against a fixed dimension of some twenty rows, so it is broadcast; one row per model leaves it.
    """
    rates = F.broadcast(rate_card(models.sparkSession))
    name = F.lower(F.trim("model"))
    hit = models.join(rates, (name != "") & name.contains(F.col("rate_key")), "left")
    best = hit.groupBy("provider", "model").agg(F.max(F.when(F.col("rate_key").isNotNull(), F.struct(F.length("rate_key").alias("n"), "rate_key", "rate_in", "rate_out"))).alias("b"))
    fall_in, fall_out = F.lit(DEFAULT_RATE[0]), F.lit(DEFAULT_RATE[1])
    for provider, (a, b) in PROVIDER_RATES.items():
        named = F.lit(provider in LOCAL_PROVIDERS) | (F.coalesce(F.trim("model"), F.lit("")) != "")
        fall_in = F.when((F.col("provider") == provider) & named, a).otherwise(fall_in)
        fall_out = F.when((F.col("provider") == provider) & named, b).otherwise(fall_out)
    return best.select("provider", "model", F.col("b.rate_key").alias("price_key"), F.coalesce("b.rate_in", fall_in).alias("rate_in"), F.coalesce("b.rate_out", fall_out).alias("rate_out"))


def flat_cost(prompt: Column, completion: Column, rate_in: Column, rate_out: Column) -> Column:
    return prompt / 1e6 * rate_in + completion / 1e6 * rate_out


def tiered_cost(model: Column, prompt: Column, completion: Column, cached: Column, peak: Column) -> Column:
    """SCA-45: cached tokens, at most the prompt's, at the cached rate; the card by exact trimmed model name."""
    p, c = F.greatest(F.coalesce(prompt, F.lit(0)), F.lit(0)), F.greatest(F.coalesce(completion, F.lit(0)), F.lit(0))
    hit = F.least(p, F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)))

    def rate(k: int) -> Column:
        out = F.when(peak, TIER_RATES[TIER_DEFAULT][1][k]).otherwise(TIER_RATES[TIER_DEFAULT][0][k])
        for key, (off, on) in TIER_RATES.items():
            out = F.when(F.trim(model) == key, F.when(peak, on[k]).otherwise(off[k])).otherwise(out)
        return out

    return (hit * rate(0) + (p - hit) * rate(1) + c * rate(2)) / 1e6


def stage(tokens: Column, stages=XP_STAGES) -> Column:
    """SCA-47: the key of the highest stage reached."""
    out = F.lit(stages[0][1])
    for least, key in stages[1:]:
        out = F.when(tokens >= least, key).otherwise(out)
    return out


def stage_progress(xp: Column) -> Column:
    """Share of the way from this stage to the next; 1 at the last."""
    out = F.lit(1.0)
    for (low, _), (high, _) in reversed(list(zip(XP_STAGES, XP_STAGES[1:]))):
        out = F.when(xp < high, (xp - low) / F.lit(float(high - low))).otherwise(out)
    return out


def mood(total: Column, local_share: Column, trend: Column) -> Column:
    """SCA-48: the companion's mood from the local share and its trend."""
    return (
        F.when(total == 0, "Dreaming of first tokens").when(local_share >= 0.75, "Homestead Hero").when(local_share >= 0.4, "Balanced Buddy")
        .when((local_share > 0) & (F.coalesce(trend, F.lit(0.0)) > 0.05), "Rooting In").when(local_share > 0, "Cloud Curious").otherwise("Cloud Surfer")
    )


def format_tokens(n: Column) -> Column:
    """SCA-46: 5.5k, 10k, 1000k, 1.5M; whole thousands from ten thousand on."""
    one = lambda x, unit: F.concat(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))
    n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("double")
    return (
        F.when(n >= 1e9, one(n / 1e9, "B")).when(n >= 1e6, one(n / 1e6, "M")).when(n >= 1e4, F.concat(F.floor(n / 1e3 + 0.5).cast("string"), F.lit("k")))
        .when(n >= 1e3, one(n / 1e3, "k")).otherwise(n.cast("long").cast("string"))
    )


def format_cost(usd: Column) -> Column:
    return F.when(usd.isNull(), "—").when(usd < 0.01, "<$0.01").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", usd.cast("double"))))


def trend_band(x: Column) -> Column:
    """AGG-25: flat within three hundredths, else up or down with whole per cent."""
    pct = F.floor(F.abs(x) * 100 + 0.5).cast("string")
    return F.when(x.isNull(), None).when(F.abs(x) < 0.03, "flat").when(x > 0, F.concat(F.lit("up "), pct, F.lit("%"))).otherwise(F.concat(F.lit("down "), pct, F.lit("%")))
