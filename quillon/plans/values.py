"""Queries of small functions and of forms that the other modules only use inside: stashed columns, digests, arrays, plug-ins, resumed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons as J
from ..functions import text as T
from ..operators import agents as A
from ..operators import attempts, normalize, reports, rowfuncs, sampling, stats
from ..streaming import streams as L
from .common import checkpoint_folder, dealt, table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def value_stash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns put aside; one name is written anew and keeps the new value, the other comes back."""
    aside = normalize.stash(_parts(spark, sf_dir).select("p_partkey", "p_name", "p_type", "p_brand"), ["p_name", "p_type"])
    return normalize.unstash(aside.withColumn("p_name", F.lower("p_brand")).drop("p_brand"))


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of whole texts, and a digest of the text in Unicode words."""
    each = T.sentences(F.col("text"), ".!?;", lines=True)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(each).cast("long").alias("n"), F.md5(F.array_join(each, "|").cast("binary")).alias("pieces"), F.md5(T.norm_unicode(F.col("text")).cast("binary")).alias("plain"))


def value_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON with sorted keys, and its digests."""
    j = normalize.canonical_json(["p_size", "p_name", "p_brand"])
    return _parts(spark, sf_dir).select("p_partkey", j.alias("json"), F.sha2(j, 256).alias("sha"), F.md5(j.cast("binary")).alias("md"), F.sha1(j.cast("binary")).alias("id"))


def value_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as mean and deviation."""
    return _parts(spark, sf_dir).select("p_partkey", reports.mean_sd(F.col("p_size") / 7.0, F.col("p_size") / 13.0).alias("told"))


def value_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of two columns: how many are shared, how many stand in the first alone, and the first's letters once, a row each."""
    a, b = (F.split(F.lower(c), "") for c in ("p_name", "p_type"))
    p = _parts(spark, sf_dir).select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("n_both"), F.size(F.array_except(a, b)).cast("long").alias("n_first"), F.posexplode(F.array_distinct(a)).alias("place", "letter"))
    return p.select("p_partkey", "n_both", "n_first", F.col("place").cast("long").alias("place"), "letter")


def value_argument_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of which one value differs, or one key is missing, or that are no JSON."""
    k = F.col("p_partkey") % 4
    mine = F.when(k == 3, F.lit("{")).otherwise(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.when(k < 2, F.col("p_size")).alias("size"))))
    gold = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.when(k == 0, F.col("p_size")).otherwise(-1).alias("size")))
    return _parts(spark, sf_dir).select("p_partkey", F.round(J.argument_f1(mine, gold), 6).alias("f1"))


def label_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: responses (stand-in: whether a text is long) against the quality label, by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 2).cast("int").alias("response")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.exact_match(d, ["lang"], "response", "quality").withColumn("accuracy", F.round("accuracy", 6))


def norm_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of different shapes, each read by its own; parts as instructions, as answers and as messages."""
    p = _parts(spark, sf_dir)
    turn = F.array(F.struct(F.lit("human").alias("from"), F.col("p_type").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("p_name").alias("value")))
    shapes = [
        p.select(F.col("p_name").alias("instruction"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("input"), F.col("p_brand").alias("output")),
        p.select(F.col("p_brand").alias("prompt"), F.col("p_name").alias("answer")), p.select(turn.alias("conversations")),
    ]
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    parts = [normalize.auto(s).select(F.lit(normalize.shape_of(s.columns)).alias("shape"), told.alias("told")) for s in shapes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rows_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labelled questions and as filled templates."""
    p = _parts(spark, sf_dir)
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("told")
    a = rowfuncs.labelled(p.select(F.col("p_name").alias("query"), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).alias("label"))).select(told, "label")
    b = rowfuncs.generation(p.select(F.col("p_name").alias("query"), F.col("p_type").alias("response")), "Tell of {{QUERY}}, please.").select(told, F.lit(None).cast("int").alias("label"))
    return a.unionByName(b)


def event_query_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: a user's events as candidates: each purchase starts a query, what stands before the first is left out."""
    s = attempts.sessions(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    return s.filter("session > 0").select("event_id", F.col("session").alias("query"))


def doc_shuffled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each document's place in hash order."""
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("_h", sampling.hash_order(42, "shuffle", F.col("doc_id")))
    return sampling.spread_rank(d, [], "_h", ["doc_id"], "place").select("doc_id", F.col("place").cast("long").alias("place"))


def event_plugin_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of one's own over all events: rows, and whole units of value by type."""

    def update(state, frame):
        for t, v in zip(frame["event_type"], frame["value"], strict=True):
            n, total = state.get(t, (0, 0))
            state[t] = (n + 1, total + int(v))
        return state

    def merge(a, b):
        return {t: tuple(x + y for x, y in zip(a.get(t, (0, 0)), b.get(t, (0, 0)), strict=True)) for t in {*a, *b}}

    e = table(spark, sf_dir, "events").filter("value is not null").select("event_type", "value")
    found = reports.Aggregate(dict, update, merge, lambda s: s).run(e, fan=2)
    return spark.createDataFrame([(t, *v) for t, v in found.items()], "event_type string, n long, units long")


def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that stops after half of the files and later goes on: each event is written once."""
    where = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for half in (0, 1):
        e.filter(F.col("event_id") % 2 == half).repartition(3).write.mode("append").parquet(f"{where}/in")
        mapped = L.read_files(spark, f"{where}/in", e.schema).filter("event_type <> 'view'").withColumn("value", F.col("value") * 2)
        L.run_available(mapped, f"{where}/out", f"{where}/state")
    return spark.read.schema(e.schema).parquet(f"{where}/out")


def agent_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls a part written in every registered format and read back."""
    name, size = F.translate(F.lower("p_brand"), "#", "_"), F.col("p_size").cast("string")
    calls = F.array(
        F.struct(name.alias("name"), F.to_json(F.struct(size.alias("size"), F.col("p_type").alias("kind"))).alias("arguments")),
        F.struct(F.concat(F.lit("then_"), name).alias("name"), F.to_json(F.struct(F.col("p_name").alias("what"))).alias("arguments")),
    )
    read = F.array(*[F.struct(F.array(*map(F.lit, keys)).alias("formats"), A.parse_calls(A.format_calls(F.col("calls"), keys[0]), keys[0]).alias("c")) for keys in A.shared_layouts()])
    parts = dealt(_parts(spark, sf_dir).select("p_partkey", "p_brand", "p_size", "p_type", "p_name"), "p_partkey")
    each = parts.select("p_partkey", calls.alias("calls")).select("p_partkey", F.inline(read))
    told = F.array_join(F.transform("c", lambda c: F.concat_ws(" ", c["name"], c["arguments"])), "|")
    return each.select("p_partkey", "formats", told.alias("told")).select("p_partkey", F.explode("formats").alias("format"), "told")


_FORMATS = "chatglm4 deepseek_v3_1 deepseek_v4 gemma4 glm4 glm4_5 glm4_7 glm5_1 hermes hunyuan_hermes hy_v3 hy_v3_preview kimi_k25 llama3 llama4 minicpm5 minimax_m2 minimax_m3 mistral qwen3_5 qwen3_coder qwen_en qwen_en_parallel qwen_zh qwen_zh_parallel react_en react_grpo react_zh seed_oss toolbench youtu"
_J = """'{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}'"""
QUERIES = {
    "value_stash": (value_stash, "select p_partkey, lower(p_brand) p_name, p_type from part"),
    "doc_sentences": (doc_sentences, r"""with s as (select doc_id, regexp_replace(regexp_replace(text, '([.!?;])[ \t\n\x0B\f\r]+', '\1' || chr(30), 'g'), '\n+', chr(30), 'g') x, text from documents)
        select doc_id, len(string_split(x, chr(30)))::bigint n, md5(replace(x, chr(30), '|')) pieces, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}]+', ' ', 'g'))) plain from s"""),
    "value_hashes": (value_hashes, f"with j as (select p_partkey, {_J} j from part) select p_partkey, j as json, sha256(j) sha, md5(j) md, sha1(j) id from j"),
    "value_mean_sd": (value_mean_sd, "select p_partkey, printf('%.2f±%.2f', p_size / 7.0::double, p_size / 13.0::double) told from part"),
    "value_arrays": (value_arrays, """with p as (select p_partkey, string_split(lower(p_name), '') a, string_split(lower(p_type), '') b from part), u as (select *, list_filter(a, lambda x, i: list_position(a, x) = i) d from p)
        select p_partkey, len(list_filter(d, lambda x: list_contains(b, x)))::bigint n_both, len(list_filter(d, lambda x: not list_contains(b, x)))::bigint n_first, (unnest(range(1, len(d) + 1)) - 1)::bigint place, unnest(d) letter from u"""),
    "value_argument_f1": (value_argument_f1, """select p_partkey, case p_partkey % 4 when 0 then 1.0 when 1 then 0.75 when 2 then round(2 / 3.0::double, 6) else 0.0 end::double f1 from part"""),
    "label_exact_match": (label_exact_match, "select lang, count(*) n, count(*) filter (n_chars % 2 = quality) n_right, round(count(*) filter (n_chars % 2 = quality) / count(*)::double, 6) accuracy from documents join labels using (doc_id) where quality is not null group by 1"),
    "norm_auto": (norm_auto, """select 'alpaca' shape, 'user:' || p_name || case when p_partkey % 2 = 0 then chr(10) || p_type else '' end || '|assistant:' || p_brand told from part
        union all select 'response', 'user:' || p_brand || '|assistant:' || p_name from part union all select 'messages', 'user:' || p_type || '|assistant:' || p_name from part"""),
    "rows_generated": (rows_generated, "select 'user:' || p_name told, p_size as label from part where p_size % 3 > 0 union all select 'user:Tell of ' || p_name || ', please.|assistant:' || p_type, null from part"),
    "event_query_groups": (event_query_groups, "select event_id, q as query from (select event_id, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id)::bigint q from events) where q > 0"),
    "doc_shuffled_places": (doc_shuffled_places, "select doc_id, row_number() over (order by sha256('42|shuffle|' || doc_id::varchar), doc_id) place from documents"),
    "event_plugin_metric": (event_plugin_metric, "select event_type, count(*) n, sum(trunc(value))::bigint units from events where value is not null group by 1"),
    "stream_resumed": (stream_resumed, "select event_id, event_type, value * 2 as value from events where event_type <> 'view'"),
    "agent_formats": (agent_formats, f"""with f as (select unnest(string_split('{_FORMATS}', ' ')) format), p as (select p_partkey, replace(lower(p_brand), '#', '_') n, p_size, p_type, p_name from part)
        select p_partkey, format, n || ' {{"size":"' || p_size || '","kind":"' || p_type || '"}}|then_' || n || ' {{"what":"' || p_name || '"}}' told from p cross join f"""),
}
