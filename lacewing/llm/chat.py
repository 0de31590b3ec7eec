"""Chat formatting: logged snapshots of growing conversations are collapsed to the maximal ones, which are then rendered. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacewing.llm.common import PRE

#: One turn of the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the 128-bit hash of all turns up to there.

    The rolling hash is the exclusive or of one hash per (place, role, text), so it is carried from turn to turn in a running frame;
    as the place is part of each, another order gives another hash.
    """
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn(PRE + "n", F.row_number().over(place))
    parts = ["role is null", "coalesce(role, '')", "text is null", "coalesce(text, '')"]
    each = lambda salt: F.expr(f"xxhash64({salt}, {PRE}n, {', '.join(parts)})")
    return turns.withColumns({PRE + "a": F.bit_xor(each(1)).over(upto), PRE + "b": F.bit_xor(each(2)).over(upto)})


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one begins with; of equal ones, that with the smallest conv_id.

    Every prefix is reduced to (length, hash) and made distinct before the anti-join, on both sides, so neither a very common
    first turn nor a conversation that was logged very often is dealt to one task.
    """
    key = [PRE + "n", PRE + "a", PRE + "b"]
    hashed = prefix_hashes(turns).select("conv_id", *key)
    last = Window.partitionBy("conv_id").orderBy(F.col(key[0]).desc())
    ranked = hashed.withColumn(PRE + "whole", F.row_number().over(last) == 1)
    whole = ranked.where(PRE + "whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    covered = ranked.where(f"not {PRE}whole").select(*key).distinct()
    return whole.join(covered, key, "left_anti").select("conv_id", "n_logged")


def render(turns: DataFrame) -> DataFrame:
    """Collapse snapshots and render what is left: conv_id, n_turns, n_logged (equal logs it stands for), text.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are ordered by (turn, role, text), nulls first; repeated rows are
    turns of their own. Null roles and texts render as empty, but differ from empty ones when conversations are compared. Rows with a null
    conv_id belong to no conversation and are left out. An empty table gives none. A conversation becomes one text, so
    its turns meet in one row: it must fit into memory, as any string.
    """
    turns = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    part = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    order = F.struct("turn", "role", "text", part.alias("part"))
    kept = turns.join(maximal(turns), "conv_id")
    texts = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("parts"), F.max("n_logged").alias("n_logged"))
    return texts.select("conv_id", F.size("parts").cast("long").alias("n_turns"), "n_logged", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"))


ORACLE = f"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n,
                  case when role is null then 'n' else 'r' || length(role) || ':' || role end || case when text is null then 'n' else 't' || length(text) || ':' || text end as item,
                  '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE.strip()}' || chr(10) as part
           from conversations where conv_id is not null),
p as (select conv_id, n, count(*) over (partition by conv_id) as n_turns, string_agg(item, '|') over (partition by conv_id order by n) as prefix,
             string_agg(part, '') over (partition by conv_id order by n) as text from t),
whole as (select prefix, n, min(conv_id) as conv_id, count(*) as n_logged, min(text) as text from p where n = n_turns group by prefix, n),
covered as (select distinct prefix, n from p where n < n_turns)
select conv_id, n::bigint as n_turns, n_logged::bigint as n_logged, text from whole anti join covered using (prefix, n)"""
