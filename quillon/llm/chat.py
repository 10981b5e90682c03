"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant the dialogue is rendered once with that speaker as
`assistant` and the others as named `user`s; system turns stay system turns. The
mask lists the characters that training should predict: the assistant's contents
with their end marks.

A dialogue is rendered in segments of `turns_per_segment` turn numbers, so a very
long one is shared by many tasks; `char_start` is where the segment's text begins
in the whole rendering, and the segments in order are the rendering. Nearly all
dialogues are one segment. Segments' lengths come from sums over their turns, so
that no text is shuffled or gathered once it is rendered: only a row of numbers a
segment and speaker goes through the window.

Cases: a null text is empty; a null role is the participant `unknown`; a null turn
comes first; rows that agree in conversation and turn are ordered by role and
text; repeated rows are repeated turns; a dialogue without participants (system
turns only) gives no row; a null conversation id is a dialogue of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _name(role):
    """A speaker's name without characters that could end the header."""
    return F.regexp_replace(role, r"[\r\n<>|]", "_")


def rotate(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    turns_per_segment: int = 256, system: str = "system",
) -> DataFrame:
    """(conv_id, speaker, segment, n_turns, n_own, text, char_start, spans): spans are [from, to) within the segment's text."""
    own = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("unknown")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    own = own.withColumn("segment", F.coalesce(F.floor(F.col("turn") / turns_per_segment), F.lit(-1)).cast("long"))
    listed = own.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    grid = _places(own, system)
    same = F.expr("a.conv_id <=> b.conv_id and a.segment = b.segment")
    both = listed.alias("a").join(grid.alias("b"), same).select("a.conv_id", "speaker", "a.segment", "t", "char_start")

    def head(x):
        named = F.concat(F.lit("user name="), _name(x["role"]))
        return F.concat(F.lit(START), F.when(x["role"] == system, F.lit("system")).when(x["role"] == F.col("speaker"), F.lit("assistant")).otherwise(named), F.lit("\n"))

    parts = F.transform("t", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), (x["role"] == F.col("speaker")).alias("own")))
    shaped = both.select("conv_id", "speaker", "segment", "char_start", parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"])), "")
    spans = _spans("parts")
    return shaped.select(
        "conv_id", "speaker", "segment", F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda x: x["own"])).cast("long").alias("n_own"), text.alias("text"), spans.alias("spans"), "char_start",
    )


#: Turns whose spans one fold appends to one list; lists that grow in a fold are copied at each step.
FOLD = 256
SPANS = "array<struct<from:bigint,to:bigint>>"


def _spans(parts: str):
    """[from, to) of the own bodies in the text of all parts: folds over runs of FOLD parts, whose beginnings a fold over the runs gives."""
    length = lambda x: (F.length(x["head"]) + F.length(x["body"])).cast("long")
    zero = F.lit(0).cast("long")

    def within(run):
        step = lambda a, x: F.struct(
            (a["at"] + length(x)).alias("at"), F.when(x["own"], F.array_append(a["spans"], F.struct((a["at"] + F.length(x["head"])).alias("from"), (a["at"] + length(x)).alias("to")))).otherwise(a["spans"]).alias("spans")
        )
        return F.aggregate(run, F.struct(zero.alias("at"), F.array().cast(SPANS).alias("spans")), step)

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD).cast("int")), lambda k: within(F.slice(parts, k * FOLD + 1, FOLD)))
    start = F.struct(zero.alias("at"), F.array().cast("array<array<struct<from:bigint,to:bigint>>>").alias("out"))
    moved = lambda a, r: F.transform(r["spans"], lambda s: F.struct((s["from"] + a["at"]).alias("from"), (s["to"] + a["at"]).alias("to")))
    return F.flatten(F.aggregate(runs, start, lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.array_append(a["out"], moved(a, r)).alias("out")))["out"])


def _places(own: DataFrame, system: str) -> DataFrame:
    """(conv_id, segment, speaker, char_start): a rendering's length before each segment, from sums by segment and role."""
    named = F.when(F.col("role") == system, F.lit(len("system"))).otherwise(F.length(F.concat(F.lit("user name="), _name(F.col("role")))))
    marks = len(START) + len("\n") + len(END)
    by_role = own.groupBy("conv_id", "segment", "role").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    by_role = by_role.select("*", named.cast("long").alias("head"))
    segments = by_role.groupBy("conv_id", "segment").agg(F.sum(F.col("chars") + F.col("n") * (F.col("head") + marks)).alias("all"))
    spoken = by_role.filter(F.col("role") != system).select("conv_id", "segment", F.col("role").alias("speaker"), (F.col("n") * (F.lit(len("assistant")) - F.col("head"))).alias("more"))
    speakers = spoken.select("conv_id", "speaker").distinct()
    each = segments.alias("s").join(speakers.alias("p"), F.expr("s.conv_id <=> p.conv_id")).select("s.conv_id", "segment", "speaker", "all")
    on = F.expr("e.conv_id <=> o.conv_id and e.segment = o.segment and e.speaker = o.speaker")
    sized = each.alias("e").join(spoken.alias("o"), on, "left").select("e.conv_id", "e.segment", "e.speaker", (F.col("all") + F.coalesce("more", F.lit(0).cast("long"))).alias("size"))
    before = W.partitionBy("conv_id", "speaker").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    return sized.select("conv_id", "segment", "speaker", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("char_start"))


SQL = r"""
with t as (select conv_id, turn, coalesce(role, 'unknown') role, coalesce(text, '') text, coalesce(floor(turn / 256), -1)::bigint segment,
                  row_number() over (partition by conv_id order by turn nulls first, role, text) o from conversations),
s as (select distinct conv_id, role speaker from t where role <> 'system'),
p as (select t.conv_id, speaker, segment, o, role = speaker own,
             '<|im_start|>' || case when role = 'system' then 'system' when role = speaker then 'assistant' else 'user name=' || regexp_replace(role, '[\r\n<>|]', '_', 'g') end || chr(10) head,
             text || '<|im_end|>' || chr(10) body
      from t join s on t.conv_id is not distinct from s.conv_id),
c as (select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, speaker, segment order by o rows between unbounded preceding and 1 preceding), 0)::bigint place from p),
g as (select conv_id, speaker, segment, count(*) n_turns, count(*) filter (own) n_own, string_agg(head || body, '' order by o) text,
             coalesce(string_agg((place + length(head))::varchar || '-' || (place + length(head) + length(body))::varchar, ',' order by o) filter (own), '') mask
      from c group by all)
select conv_id, speaker, segment, n_turns, n_own, text, mask,
       coalesce(sum(length(text)) over (partition by conv_id, speaker order by segment rows between unbounded preceding and 1 preceding), 0)::bigint char_start from g
"""
