"""Conversations: search, titles, token estimates and context budgets.

FLT-01/02, SCA-18/50/51/63/64, WIN-07/08/10, TOP-12, AGG-21, DML-08, STR-15. Messages are (conv_id, turn, role, text). Windows hold
one conversation's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

IMAGE_TOKENS = 1024
#: Characters a token, share of a context that input may take, budget of unknown providers in characters.
TOKEN_CHARS, INPUT_SHARE, UNKNOWN_BUDGET = 3.5, 0.8, 200_000
#: Contexts in tokens of local providers where none is set, of hosted models and of their unknown models.
LOCAL_CONTEXT = {"ollama": 4096, "unsloth": 8192}
OPENAI_CONTEXT, OPENAI_OTHER = {
    "gpt-4o": 128_000, "gpt-4o-mini": 128_000, "o1": 200_000, "o1-mini": 128_000, "o3": 200_000, "o3-mini": 200_000, "o4-mini": 200_000,
    "gpt-4.1": 1_047_576, "gpt-4.1-mini": 1_047_576, "gpt-4.1-nano": 1_047_576,
}, 32_000
ANTHROPIC_CONTEXT, ANTHROPIC_OTHER = {
    "claude-3-5-sonnet-20241022": 200_000, "claude-3-5-haiku-20241022": 200_000, "claude-3-7-sonnet-20250219": 200_000, "claude-sonnet-4-20250514": 200_000,
    "claude-opus-4-20250514": 200_000, "claude-3-opus-20240229": 200_000, "claude-3-haiku-20240307": 200_000,
}, 100_000
OPENAI_MODEL = "gpt-4o"
DEEPSEEK_INPUT = 616_000
#: Characters of a memory, of a request that folds turns into it, and of the turns in it at least.
MEMORY_CHARS, FOLD_CHARS, FOLD_LEAST = 4000, 32_000, 1000
TRIMMED_MARK = "[...older messages trimmed...]\n\n"


def search(messages: DataFrame, needle: str) -> DataFrame:
    """FLT-02: conversations with a message that holds the words, whatever their case."""
    return messages.where(F.lower("text").contains(needle.lower())).groupBy("conv_id").agg(F.count("*").alias("n_hits"))


def titles(messages: DataFrame) -> DataFrame:
    """SCA-18: a title from the first user message."""
    first = messages.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("t"), F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("u"))
    return first.select("conv_id", T.default_title(F.when(F.col("u").isNotNull(), F.col("t"))).alias("title"))


def token_estimates(messages: DataFrame) -> DataFrame:
    """SCA-49/50: tokens of each conversation: six for a message, its role and its text."""
    each = F.lit(6) + T.estimate_tokens(F.col("role")) + T.estimate_tokens(F.col("text"))
    return messages.groupBy("conv_id").agg(F.sum(each).alias("tokens"), F.count("*").alias("messages"))


def json_size(role: Column, text: Column) -> Column:
    """SCA-64: characters of a message as JSON."""
    return F.length(F.to_json(F.struct(role.alias("role"), text.alias("content"))))


def budget_tail(messages: DataFrame, budget: int, size: Column | None = None) -> DataFrame:
    """WIN-07: for each conversation the first turn that is kept: the earliest suffix within the budget, yet never without
    the newest user turn; all turns without one. A suffix of n messages costs their sizes and n + 1."""
    size = json_size(F.col("role"), F.col("text")) if size is None else size
    later = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("conv_id")
    m = messages.withColumn("_s", size.cast("long")).withColumn("_tail", F.sum("_s").over(later) + F.count("*").over(later) + 1)
    m = m.withColumn("_user", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(every)).withColumn("_first", F.min("turn").over(every))
    fit = F.min(F.when(F.col("_tail") <= budget, F.col("turn")))
    out = m.groupBy("conv_id").agg(fit.alias("fit"), F.max("_user").alias("user"), F.min("_first").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"))
    start = F.when(F.col("user").isNull(), F.col("first")).otherwise(F.least(F.coalesce("fit", "user"), F.col("user")))
    return out.select("conv_id", start.alias("start_turn"), (start - F.col("first")).alias("folded"), "n")


def system_suffix(messages: DataFrame, budget: int, size: Column | None = None) -> DataFrame:
    """WIN-08: the kept turns of conversations over the budget: the first and the longest suffix that fits with it, at
    least the last; those of up to four messages are kept whole."""
    size = json_size(F.col("role"), F.col("text")) if size is None else size
    later = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("conv_id")
    m = messages.withColumn("_s", size.cast("long")).withColumn("_sum", F.sum("_s").over(later)).withColumn("_k", F.count("*").over(later))
    m = m.withColumn("_n", F.count("*").over(every)).withColumn("_all", F.sum("_s").over(every) + F.col("_n") + 1)
    m = m.withColumn("_head", F.max(F.when(F.col("_k") == F.col("_n"), F.col("_s"))).over(every))
    whole = (F.col("_n") <= 4) | (F.col("_all") <= budget)
    fits = (F.col("_k") < F.col("_n")) & (F.col("_head") + F.col("_sum") + F.col("_k") + 1 + 1 <= budget)
    return m.where(whole | (F.col("_k") == F.col("_n")) | (F.col("_k") == 1) | fits).select("conv_id", "turn", "role")


def excerpt(messages: DataFrame, most: int = 8000, each: int = 600) -> DataFrame:
    """WIN-10: leading turns, each cut to `each` characters, until their lengths pass `most`."""
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cut = messages.withColumn("excerpt", F.substring(F.coalesce("text", F.lit("")), 1, each))
    return cut.withColumn("running", F.sum(F.length("excerpt")).over(upto)).where(F.col("running") <= most).select("conv_id", "turn", "role", "excerpt", "running")


def context_breakdown(messages: DataFrame) -> DataFrame:
    """AGG-21: tokens by role and their share of all."""
    by = messages.groupBy("role").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))
    return by.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def recent(conversations: DataFrame, current: int, n: int = 5) -> DataFrame:
    """TOP-12: the newest conversations that are neither current nor archived."""
    return conversations.where((F.col("conv_id") != current) & ~F.coalesce("archived", F.lit(False))).orderBy(F.desc("conv_id")).limit(n)


def of_hits(hits: DataFrame, conversations: DataFrame) -> DataFrame:
    """JN-13: hits (id, session_id) with the conversation (conv_id, title) that their session names; null where there is none."""
    known = conversations.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.first("conv_id").alias("conv_id"), F.min("title").alias("title"))
    return hits.join(known, "session_id", "left").select("id", "session_id", "conv_id", "title")


def flatten_blocks(blocks: Column) -> Column:
    """SCA-63: the text of typed blocks, joined by spaces; other blocks have none."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "tool_result")), lambda b: b["text"]), " ")


def block_tokens(blocks: Column) -> Column:
    """SCA-50: an image costs a fixed count, other blocks their JSON."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.when(b["type"].isin("image", "image_url"), IMAGE_TOKENS).otherwise(T.estimate_tokens(F.to_json(b))))


def _looked_up(key: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def provider_budget(provider: Column, model: Column, context: Column) -> Column:
    """SCA-51: characters of input that a provider's model takes; an unset OpenAI model is OPENAI_MODEL; `context` is a local provider's setting in tokens, if above 0."""
    share = lambda tokens: F.floor(tokens * INPUT_SHARE * TOKEN_CHARS)
    local = F.when(context > 0, context).otherwise(_looked_up(provider, LOCAL_CONTEXT, 0))
    return (
        F.when(provider.isin(*LOCAL_CONTEXT), share(local))
        .when(provider == "deepseek", F.floor(F.lit(DEEPSEEK_INPUT * TOKEN_CHARS)))
        .when(provider == "openai", share(_looked_up(F.lower(F.coalesce(model, F.lit(OPENAI_MODEL))), OPENAI_CONTEXT, OPENAI_OTHER)))
        .when(provider == "anthropic", share(_looked_up(F.coalesce(model, F.lit("")), ANTHROPIC_CONTEXT, ANTHROPIC_OTHER)))
        .otherwise(UNKNOWN_BUDGET)
        .cast("long")
    )


def fold_transcripts(messages: DataFrame, start: DataFrame, instruction: str = "", most: int = FOLD_CHARS) -> DataFrame:
    """STR-15: (conv_id, transcript): the turns before `start(conv_id, start_turn)` as one text for a model that folds them into
    the conversation's memory, `start` may have one as `memory`. Beyond the request's room the newest characters stay, under a mark.

    Sizes are summed from the newest turn on and turns out of reach never meet the others, so a group holds `most` characters.
    """
    memory = F.col("memory") if "memory" in start.columns else F.lit("")
    cap = F.greatest(F.lit(FOLD_LEAST), most - len(instruction) - F.length(F.trim(F.coalesce(memory, F.lit("")))) - 200)
    said = F.concat(F.lit("["), F.coalesce(F.when(F.col("role") != "", F.col("role")), F.lit("unknown")), F.lit("] "), F.coalesce("text", F.lit("")))
    later = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("said")).rowsBetween(Window.unboundedPreceding, 0)
    old = messages.join(start.select("conv_id", "start_turn", cap.alias("cap")), "conv_id").where("turn < start_turn").withColumn("said", said)
    old = old.withColumn("upto", F.sum(F.length("said") + 2).over(later) - 2)
    near = old.where(F.col("upto") - F.length("said") - 2 <= F.col("cap"))
    each = near.select("conv_id", "turn", "upto", "cap", F.substring("said", F.greatest(F.lit(1), F.length("said") - F.col("cap") + 1), F.length("said")).alias("said"))
    made = each.groupBy("conv_id", "cap").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("upto", "said")), False), lambda x: x["said"]), "\n\n").alias("t"), F.max("upto").alias("whole"))
    cut = F.concat(F.lit(TRIMMED_MARK), F.substring("t", F.length("t") - F.col("cap") + 1, F.col("cap")))
    return made.select("conv_id", F.when(F.col("whole") > F.col("cap"), cut).otherwise(F.col("t")).alias("transcript"))


def memory_reply(reply: Column, most: int = MEMORY_CHARS) -> Column:
    """STR-15: a model's memory, trimmed and cut; null if there is nothing, so that the one before stays."""
    said = F.regexp_replace(reply, r"^\s+|\s+\z", "")
    return F.when(said != "", F.regexp_replace(F.substring(said, 1, most), r"\s+\z", ""))
