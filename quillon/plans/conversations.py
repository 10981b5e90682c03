"""Queries of the conversation operators over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation as C


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.to_messages(_turns(spark, sf_dir))


def _flat(messages):
    """Messages as one string, for comparison."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")


def conv_to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canonical row per conversation."""
    return _conv(spark, sf_dir).select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(_flat(F.col("messages")).cast("binary")).alias("digest"))


def conv_role_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each conversation is valid, and how many assistant turns it has."""
    m = F.col("messages")
    return _conv(spark, sf_dir).select("conv_id", C.valid_messages(m).alias("valid"), F.size(F.filter(m, lambda x: x["role"] == "assistant")).cast("long").alias("n_assistant"), C.has_system(m).alias("with_system"))


def conv_last_user_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each conversation's last user message."""
    return _conv(spark, sf_dir).select("conv_id", C.last_user_round(F.col("messages")).cast("long").alias("last_user"))


def conv_history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns as rounds."""
    return C.history_pairs(_turns(spark, sf_dir))


def conv_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of one role joined."""
    return C.merge_runs(_turns(spark, sf_dir))


def conv_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens of each turn, cut to 12 from either side, and in chunks."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    t = _turns(spark, sf_dir).select("conv_id", "turn", words.alias("w"))
    return t.select("conv_id", "turn", F.array_join(C.truncate(F.col("w"), 12), " ").alias("right"), F.array_join(C.truncate(F.col("w"), 12, "left"), " ").alias("left"), F.size(C.split_chunks(F.col("w"), 12)).cast("long").alias("n_chunks"))


def conv_loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message weights by strategy; also with a message's own loss and weight, which follow from its length."""
    m = F.col("messages")
    own = F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.when(F.length(x["content"]) % 3 != 0, F.length(x["content"]) % 3 == 1).alias("loss"), F.when(F.length(x["content"]) % 2 == 0, F.lit(2.0)).alias("loss_scale")))
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")
    s = lambda k: flat(C.loss_scale(m, k))
    return _conv(spark, sf_dir).select("conv_id", s("default").alias("by_default"), s("last_round").alias("last_round"), s("all").alias("all_turns"), flat(C.loss_scale(own, "last_round", ("loss", "loss_scale"))).alias("by_own"))


def conv_system_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed system prompt, and the last answer removed."""
    m = C.strip_response(C.override_system(F.col("messages"), F.lit("You are careful.")))
    return _conv(spark, sf_dir).select("conv_id", F.md5(_flat(m).cast("binary")).alias("digest"), F.size(m).cast("long").alias("n"))


def conv_role_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed roles (stand-in: user and assistant under their other names)."""
    other = {"user": "human", "assistant": "gpt"}
    m = C.rename_roles(C.rename_roles(F.col("messages"), other), C.ROLE_ALIASES)
    return _conv(spark, sf_dir).select("conv_id", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"))


def conv_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected view; stand-in for the rejected answer: the first user turn's text reversed."""
    m = F.col("messages")
    rejected = F.reverse(F.get(F.filter(m, lambda x: x["role"] == "user"), 0)["content"])
    v = C.preference_view(m, rejected)
    return _conv(spark, sf_dir).select("conv_id", F.size(v).cast("long").alias("n_rejected"), F.get(v, F.size(v) - 1)["content"].alias("rejected")).filter("rejected is not null")


def conv_kto_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers rotated in batches of 16 rounds (in order of conversation)."""
    first = C.history_pairs(_turns(spark, sf_dir)).filter("round = 1 and response is not null").select("conv_id", "response")
    return C.rotate_in_batches(first, "conv_id", "response", 16)


def conv_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first two turns as instruction and input; every third input is empty."""
    m = F.col("messages")
    a, b = F.get(m, 0)["content"], F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.get(m, 1)["content"])
    q = C.alpaca_query(a, b)
    msgs = C.from_response(F.lit(None).cast("string"), F.lit(None).cast("array<array<string>>"), q, F.lit("done"))
    return _conv(spark, sf_dir).select("conv_id", F.md5(_flat(msgs).cast("binary")).alias("digest"), F.size(msgs).cast("long").alias("n"))


def conv_rank_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rerank records; the answer is the positive, the other user turns are negatives."""
    m = F.col("messages")
    ask = F.transform(F.filter(m, lambda x: x["role"] == "user"), lambda x: x["content"])
    ans = F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: x["content"])
    r = C.ranking_records(F.get(ask, 0), F.slice(ans, 1, 1), F.slice(ask, F.lit(2), F.greatest(F.size(ask) - 1, F.lit(0))))
    out = _conv(spark, sf_dir).select("conv_id", F.posexplode(r).alias("i", "r"))
    return out.select("conv_id", F.col("i").cast("long").alias("i"), F.col("r.label").alias("label"), F.col("r.messages")[1]["content"].alias("doc"))


_M = """m as (select conv_id, role, text, turn, row_number() over (partition by conv_id order by turn) i, count(*) over (partition by conv_id) n from conversations)"""
QUERIES = {
    "conv_to_messages": (conv_to_messages, "select conv_id, count(*) n, md5(string_agg(role || ':' || text, chr(10) order by turn)) digest from conversations group by conv_id"),
    "conv_role_check": (conv_role_check, """select conv_id, bool_and(role in ('system','user','assistant','tool','tool_call','tool_response') and text is not null) valid,
        count(*) filter (role = 'assistant') n_assistant, bool_or(role = 'system') with_system from conversations group by conv_id"""),
    "conv_last_user_round": (conv_last_user_round, f"with {_M} select conv_id, coalesce(max(i - 1) filter (role = 'user'), -1)::bigint last_user from m group by conv_id"),
    "conv_history_pairs": (conv_history_pairs, """with s as (select *, lead(role) over w r, lead(text) over w t from conversations where role <> 'system' window w as (partition by conv_id order by turn))
        select conv_id, row_number() over (partition by conv_id order by turn) as round, text as query, case when r = 'assistant' then t end response from s where role = 'user'"""),
    "conv_islands": (conv_islands, """with a as (select *, case when lag(role) over w is not distinct from role then 0 else 1 end f from conversations window w as (partition by conv_id order by turn)),
        b as (select *, sum(f) over (partition by conv_id order by turn)::bigint island from a)
        select conv_id, island, role, string_agg(text, chr(10) order by turn) as text, count(*) n_turns from b group by conv_id, island, role"""),
    "conv_truncate": (conv_truncate, r"""with t as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') w from conversations)
        select conv_id, turn, array_to_string(w[1:12], ' ') as "right", array_to_string(w[greatest(len(w) - 11, 1):], ' ') as "left", greatest(ceil(len(w) / 12.0), 1)::bigint n_chunks from t"""),
    "conv_loss_mask": (conv_loss_mask, f"""with {_M} select conv_id, string_agg(case when role = 'assistant' then '1' else '0' end, '' order by turn) by_default,
        string_agg(case when role = 'assistant' and i = n then '1' else '0' end, '' order by turn) last_round, repeat('1', max(n)::int) all_turns,
        string_agg(case when role <> 'assistant' then '0' when length(text) % 3 = 2 or (length(text) % 3 = 0 and i < n) then '0' when length(text) % 2 = 0 then '2' else '1' end, '' order by turn) by_own from m group by conv_id"""),
    "conv_system_override": (conv_system_override, f"""with {_M}, k as (select * from m where role <> 'system' and not (i = n and role = 'assistant'))
        select c.conv_id, md5(coalesce('system:You are careful.' || chr(10) || string_agg(k.role || ':' || k.text, chr(10) order by k.turn), 'system:You are careful.')) digest, 1 + count(k.turn) n
        from (select distinct conv_id from conversations) c left join k using (conv_id) group by c.conv_id"""),
    "conv_role_alias": (conv_role_alias, "select conv_id, string_agg(role, ',' order by turn) roles from conversations group by conv_id"),
    "conv_preference_pairs": (conv_preference_pairs, f"""with {_M}, f as (select conv_id, max(i) filter (role = 'user') lu, arg_min(text, turn) filter (role = 'user') fu, arg_max(text, turn) la from m group by conv_id)
        select conv_id, lu + 1 n_rejected, reverse(fu) rejected from f where lu is not null and reverse(fu) is distinct from la"""),
    "conv_kto_rotate": (conv_kto_rotate, """with s as (select *, lead(role) over w r, lead(text) over w t from conversations where role <> 'system' window w as (partition by conv_id order by turn)),
        u as (select conv_id, t response, r, row_number() over (partition by conv_id order by turn) k from s where role = 'user'),
        f as (select conv_id, response, conv_id // 16 b from u where k = 1 and r = 'assistant')
        select conv_id, response, coalesce(lag(response) over (partition by b order by conv_id), last_value(response) over (partition by b order by conv_id rows between unbounded preceding and unbounded following)) rotated from f"""),
    "conv_alpaca": (conv_alpaca, f"""with {_M}, p as (select conv_id, max(text) filter (i = 1) a, case when conv_id % 3 = 0 then '' else max(text) filter (i = 2) end b from m group by conv_id),
        q as (select conv_id, case when nullif(a, '') is not null and nullif(b, '') is not null then a || chr(10) || b else coalesce(nullif(a, ''), nullif(b, '')) end q from p)
        select conv_id, md5(coalesce('user:' || q || chr(10), '') || 'assistant:done') digest, (case when q is null then 1 else 2 end)::bigint n from q"""),
    "conv_rank_records": (conv_rank_records, """with u as (select conv_id, text, role, row_number() over (partition by conv_id, role order by turn) k from conversations where role in ('user', 'assistant')),
        d as (select conv_id, text doc, case when role = 'assistant' then 1 else 0 end label, k from u where (role = 'assistant' and k = 1) or (role = 'user' and k > 1))
        select conv_id, row_number() over (partition by conv_id order by label desc, k) - 1 i, label, doc from d"""),
}
