"""Preference formatting: pairs of a chosen and a rejected conversation as one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once as prompt; what is left of either conversation
is its completion. If both go on with the same role, the header of that turn belongs to the prompt. A mask lists runs
``bit:length`` in code points over the completion: 1 for what an assistant turn says (with the end of the turn), 0 for headers and other turns.
Turns are compared as they are; in what is rendered ``<|`` becomes ``< |``, so no text or role can pass for a header.

Defined results: null roles and texts are empty; turns of equal number are ordered by role, then text; a null id is an id like
any other; a pair whose conversations are equal has two empty completions; if one is a prefix of the other, its completion is empty; an empty
table gives an empty result. Extra columns are not read. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): the turns of each conversation, in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), _plain(role), F.lit("|>\n"))


def _said(t: Column) -> Column:
    return F.concat(_plain(t["text"]), F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), _said(t))), "")


def _completion(rest: Column, bare: Column) -> Column:
    first = F.when(bare, _said(rest[0])).otherwise(F.concat(_header(rest[0]["role"]), _said(rest[0])))
    return F.when(F.size(rest) == 0, "").otherwise(F.concat(first, _rendered(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))))))


def _mask(rest: Column, bare: Column) -> Column:
    def runs(t: Column, k: Column) -> Column:
        head = F.when((k == 0) & bare, "").otherwise(F.concat(F.lit("0:"), F.length(_header(t["role"])).cast("string"), F.lit(",")))
        return F.concat(head, F.when(t["role"] == ASSISTANT, "1:").otherwise("0:"), F.length(_said(t)).cast("string"))

    return F.array_join(F.transform(rest, runs), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From (id, chosen, rejected), both arrays of turns: id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    same = lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
    apart = F.array_position(F.zip_with("chosen", "rejected", lambda x, y: ~same(x, y)), F.lit(True))
    n = F.when(apart == 0, F.size("chosen")).otherwise(apart - 1).cast("int")
    at = pairs.withColumn("n", n)
    rest = {c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0))) for c in ("chosen", "rejected")}
    at = at.withColumn("c", rest["chosen"]).withColumn("r", rest["rejected"])
    bare = (F.size("c") > 0) & (F.size("r") > 0) & (F.get("c", F.lit(0))["role"] == F.get("r", F.lit(0))["role"])
    at = at.withColumn("bare", F.coalesce(bare, F.lit(False)))
    prompt = F.concat(_rendered(F.slice("chosen", F.lit(1), F.col("n"))), F.when(F.col("bare"), _header(F.get("c", F.lit(0))["role"])).otherwise(""))
    c, r, b = F.col("c"), F.col("r"), F.col("bare")
    safe = lambda x: F.when(F.size(x) == 0, F.lit("")).otherwise(_completion(x, b))
    return at.select("id", F.col("n").alias("n_prompt_turns"), prompt.alias("prompt"), safe(c).alias("chosen"), safe(r).alias("rejected"), _mask(c, b).alias("chosen_mask"), _mask(r, b).alias("rejected_mask"))


def stale_reply_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs out of single conversations: chosen is the conversation; rejected gives, in place of one assistant reply, the first reply again (in place of the
    first: an empty one), and goes on as chosen does. The reply's place among the n replies is the id modulo n (no whole number: 0). Without an assistant turn, no pair."""
    talk = conversations(turns, id_col)
    places = F.filter(F.transform("turns", lambda t, k: F.when(t["role"] == ASSISTANT, k)), lambda k: k.isNotNull())
    talk = talk.withColumn("places", places).filter(F.size("places") > 0)
    talk = talk.withColumn("pick", F.pmod(F.coalesce(F.col("id").try_cast("long"), F.lit(0)), F.size("places")).cast("int"))
    talk = talk.withColumn("at", F.get("places", F.col("pick"))).withColumn("stale", F.when(F.col("pick") == 0, "").otherwise(F.get("turns", F.get("places", F.lit(0)))["text"]))
    text = lambda t, k: F.when(k == F.col("at"), F.col("stale")).otherwise(t["text"])
    rejected = F.transform("turns", lambda t, k: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text(t, k).alias("text")))
    return talk.select("id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def stale_reply_preferences(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    return format_pairs(stale_reply_pairs(turns, id_col)).withColumnRenamed("id", id_col)


PREFERENCE_SQL = """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k from conversations),
r as (select *, count(*) filter (role = 'assistant') over (partition by conv_id) as n, count(*) filter (role = 'assistant') over (partition by conv_id order by k) as a from t),
f as (select *, max(case when role = 'assistant' and a = 1 then text end) over (partition by conv_id) as first_reply from r where n > 0),
p as (select conv_id, k, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) as header, role, text as good,
             case when role = 'assistant' and a = ((coalesce(conv_id, 0) % n) + n) % n + 1 then case when a = 1 then '' else first_reply end else text end as bad from f),
d as (select *, min(case when good <> bad then k end) over (partition by conv_id) as z from p),
x as (select conv_id, z, k, header, replace(good, '<|', '< |') || chr(10) as good, replace(bad, '<|', '< |') || chr(10) as bad,
             case when role = 'assistant' then '1:' else '0:' end as bit, case when k = z then '' else header end as own from d)
select conv_id, count(*) filter (z is null or k < z)::int as n_prompt_turns,
       coalesce(string_agg(header || good, '' order by k) filter (z is null or k < z), '') || coalesce(max(header) filter (k = z), '') as prompt,
       coalesce(string_agg(own || good, '' order by k) filter (k >= z), '') as chosen, coalesce(string_agg(own || bad, '' order by k) filter (k >= z), '') as rejected,
       coalesce(string_agg(case when k = z then '' else '0:' || length(header) || ',' end || bit || length(good), ',' order by k) filter (k >= z), '') as chosen_mask,
       coalesce(string_agg(case when k = z then '' else '0:' || length(header) || ',' end || bit || length(bad), ',' order by k) filter (k >= z), '') as rejected_mask
from x group by conv_id
"""
