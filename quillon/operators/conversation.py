"""Conversation operators: turns to canonical messages, role checks, truncation, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = ("system", "user", "assistant", "tool", "tool_call", "tool_response")
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def to_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (key, messages array<struct<role, content>> in turn order).

    Partial aggregation gathers turns before the one shuffle on the key.
    """
    one = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))
    ordered = F.array_sort(F.collect_list(one))
    return turns.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def valid_messages(messages: Column) -> Column:
    """Non-empty, known roles only, no null content."""
    return (F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isin(*ROLES) & m["content"].isNotNull())


def last_user_round(messages: Column) -> Column:
    """0-based position of the last user message, -1 if there is none."""
    where = F.filter(F.sequence(F.lit(0), F.size(messages) - 1), lambda i: F.get(messages, i)["role"] == "user")
    return F.when(F.size(messages) == 0, F.lit(-1)).otherwise(F.coalesce(F.array_max(where), F.lit(-1)))


def has_system(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "system")


def history_pairs(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, round, query, response): each user turn and the assistant turn right after it, null where none follows."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order)
    spoken = turns.filter(F.col(role) != "system")
    nxt = spoken.select(key, order, role, text, F.lead(role).over(w).alias("_r"), F.lead(text).over(w).alias("_t"))
    asked = nxt.filter(F.col(role) == "user")
    return asked.select(key, F.row_number().over(w).cast("long").alias("round"), F.col(text).alias("query"), F.when(F.col("_r") == "assistant", F.col("_t")).alias("response"))


def rename_roles(messages: Column, table: dict[str, str]) -> Column:
    """Role aliases (`human`, `gpt`, `tool_response`, ...) to canonical roles; unknown roles stay."""
    pick = lambda r: F.coalesce(*[F.when(r == k, F.lit(v)) for k, v in table.items()], r)
    return F.transform(messages, lambda m: F.struct(pick(m["role"]).alias("role"), m["content"].alias("content")))


ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "tool_response": "tool", "function": "tool"}


def from_response(system: Column, history: Column, query: Column, response: Column) -> Column:
    """Messages of a query-response row: optional system, [query, response] pairs of history, then the row's own pair."""
    say = lambda role, c: F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    past = F.flatten(F.transform(F.coalesce(history, F.array().cast("array<array<string>>")), lambda p: F.array(say("user", F.get(p, 0)), say("assistant", F.get(p, 1)))))
    return F.array_compact(F.concat(F.array(say("system", system)), past, F.array(say("user", query), say("assistant", response))))


def alpaca_query(instruction: Column, extra: Column) -> Column:
    """`instruction`, a line break and `input` if both are non-empty, else the one there is."""
    a, b = F.nullif(instruction, F.lit("")), F.nullif(extra, F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("\n"), b)).otherwise(F.coalesce(a, b))


def merge_runs(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", merged: str | None = None, sep: str = "\n") -> DataFrame:
    """Consecutive turns of one role joined to one (of role `merged` only, if given): gaps and islands."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order)
    same = F.lag(role).over(w).eqNullSafe(F.col(role))
    if merged is not None:
        same = same & (F.col(role) == merged)
    marked = turns.withColumn("_new", F.when(same, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("_new").over(w).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return island.groupBy(key, "island", role).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(text), F.count("*").alias("n_turns"))


def truncate(tokens: Column, most: int, side: str = "right", protected: Column | None = None) -> Column:
    """At most `most` tokens. Protected positions (array<boolean>) are kept first; the rest from the kept side."""
    if protected is None:
        return F.slice(tokens, 1, most) if side == "right" else F.when(F.size(tokens) > most, F.slice(tokens, F.size(tokens) - most + 1, most)).otherwise(tokens)
    room = F.greatest(F.lit(most) - F.size(F.filter(protected, lambda p: p)), F.lit(0))
    at = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.get(protected, i).alias("p")))
    free = F.filter(at, lambda x: ~x["p"])
    kept = F.slice(free, 1, room) if side == "right" else F.when(F.size(free) > room, F.slice(free, F.size(free) - room + 1, room)).otherwise(free)
    places = F.transform(F.when(room > 0, kept).otherwise(F.slice(free, 1, 0)), lambda x: x["i"])
    return F.transform(F.filter(at, lambda x: x["p"] | F.array_contains(places, x["i"])), lambda x: x["t"])


def split_chunks(tokens: Column, most: int) -> Column:
    """Consecutive chunks of at most `most` tokens."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / most).cast("int")), lambda i: F.slice(tokens, i * most + 1, most))


def loss_scale(messages: Column, strategy: str = "default", own: tuple[str, ...] = ()) -> Column:
    """A weight per message: assistant turns 1 (`default`), only the last one (`last_round`), or every turn (`all`).

    `own` names the fields that messages have of `loss` and `loss_scale`: an assistant turn whose own `loss` is true or
    false counts or doesn't, whatever the strategy, and one that counts weighs its own `loss_scale` where it has one.
    """
    n = F.size(messages)
    base = {
        "all": lambda m, i: F.lit(1.0),
        "default": lambda m, i: (m["role"] == "assistant").cast("double"),
        "last_round": lambda m, i: ((m["role"] == "assistant") & (i == n - 1)).cast("double"),
    }[strategy]

    def weight(m, i):
        w = base(m, i)
        if "loss" in own:
            w = F.when((m["role"] == "assistant") & m["loss"].isNotNull(), m["loss"].cast("double")).otherwise(w)
        if "loss_scale" in own:
            w = F.when((m["role"] == "assistant") & (w > 0) & m["loss_scale"].isNotNull(), m["loss_scale"]).otherwise(w)
        return w

    return F.transform(messages, weight)


def override_system(messages: Column, system: Column) -> Column:
    """The given system prompt in place of, or before, the conversation's own; a null prompt changes nothing."""
    mine = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    rest = F.filter(messages, lambda m: m["role"] != "system")
    return F.when(system.isNull(), messages).otherwise(F.concat(mine, rest))


def strip_response(messages: Column) -> Column:
    """Messages without a last assistant turn."""
    n = F.size(messages)
    return F.when((n > 0) & (F.get(messages, n - 1)["role"] == "assistant"), F.slice(messages, 1, F.greatest(n - 1, F.lit(0)))).otherwise(messages)


def preference_view(messages: Column, rejected: Column) -> Column:
    """The rejected side: everything up to the last user turn, then the rejected response; null if there is none or it equals the answer."""
    last = last_user_round(messages)
    answer = F.get(messages, F.size(messages) - 1)["content"]
    other = F.concat(F.slice(messages, 1, last + 1), F.array(F.struct(F.lit("assistant").alias("role"), rejected.alias("content"))))
    return F.when(rejected.isNotNull() & (last >= 0) & ~rejected.eqNullSafe(answer), other)


def merge_labels(lengths: Column) -> Column:
    """Position ids of a packed row: 0, 1, ... restarting for each sequence."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


def rotate_in_batches(rows: DataFrame, order: str, value: str, batch: int) -> DataFrame:
    """Unpaired preference rows: each row also gets the value of the row before it in its batch, the first that of the last."""
    from pyspark.sql import Window as W

    numbered = rows.withColumn("_b", F.floor(F.col(order) / batch))
    w = W.partitionBy("_b").orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return numbered.withColumn("rotated", F.coalesce(F.lag(value).over(w), F.last(value).over(whole))).drop("_b")


def ranking_records(query: Column, positives: Column, negatives: Column) -> Column:
    """Records of an embedding or rerank row: (messages, label), positives 1 before negatives 0."""
    as_record = lambda label: lambda d: F.struct(F.array(F.struct(F.lit("user").alias("role"), query.alias("content")), F.struct(F.lit("assistant").alias("role"), d.alias("content"))).alias("messages"), F.lit(label).alias("label"))
    return F.concat(F.transform(positives, as_record(1)), F.transform(negatives, as_record(0)))
