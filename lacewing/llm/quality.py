"""Quality rules per document, and verdicts on whole hosts from shrunken failure rates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacewing.llm.common import PRE, checked_join, let, replace_columns, words

#: Words of the windows whose repetition counts.
WINDOW = 5
#: A host is rejected when its shrunken failure rate of some rule is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength (its number of pseudo-documents).
WEAKEST, STRONGEST = 1.0, 1000.0

#: The document rules; those of BASE reject a document by themselves, all count towards its host's rates.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}
BASE = ("short", "repeats")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at the given ascending positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; only where one does are the windows sorted."""

    def twice(s: Column) -> Column:
        again = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
        return _covered(F.array_sort(F.transform(again, lambda x: x["p"])))

    placed = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed(h), twice)).otherwise(0))


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules need; all longs.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (of these, equal to an
    earlier one) and n_repeat_words (words in a five-word window that the text has twice or more). Null text counts as empty:
    all counts are zero. Repeated rows are counted each by itself; existing columns of these names are replaced. One pass, no shuffle;
    only texts that repeat a window sort their windows.
    """
    df = replace_columns(df, *FEATURES)
    text, w = F.coalesce(F.col(text_col), F.lit("")), words(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": let(w, lambda w: F.when(F.size(w) >= WINDOW, _repeated(windows(w))).otherwise(0)),
    }
    return df.withColumns({name: count.cast("long") for name, count in counts.items()})


def base_failed() -> Column:
    return F.expr(" or ".join(f"({RULES[r]})" for r in BASE))


def rejected_hosts(featured: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts (column host) whose shrunken rate of some rule is above the limit.

    Per host and rule k of n documents fail; the beta prior of a rule has the mean and variance of the hosts' rates (by moments,
    its strength within WEAKEST and STRONGEST, STRONGEST where rates don't differ), and a host's rate is the posterior mean. Null is no
    host. Documents are counted before the shuffle, so a host with a third of all rows costs no more than another.
    """
    failed = [F.sum(F.expr(f"cast({rule} as bigint)")).alias(name) for name, rule in RULES.items()]
    hosts = featured.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *failed)
    pairs = ", ".join(f"'{name}', `{name}`" for name in RULES)
    rates = hosts.selectExpr("host", "n", f"stack({len(RULES)}, {pairs}) as (rule, k)").withColumn("rate", F.col("k") / F.col("n"))
    prior = rates.groupBy("rule").agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("variance"))
    strength = F.when(
        F.col("variance") > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.expr("mean * (1 - mean) / variance - 1")))
    ).otherwise(F.lit(STRONGEST))
    shrunk = rates.join(F.broadcast(prior.withColumn("strength", strength)), "rule")  # as many rows as there are rules
    return shrunk.where(F.expr(f"(k + mean * strength) / (n + strength) > {limit}")).select("host").distinct()


def judge(featured: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT, stats_from: DataFrame | None = None) -> DataFrame:
    """Add base_failed and kept to rows with features: kept is false for a failed base rule or a rejected host.

    stats_from: where the hosts' rates are taken from, if not from the rows themselves. An empty table gives an empty table; rows
    with a null host are judged by the base rules alone; repeated rows get the same verdict.
    """
    bad = rejected_hosts(featured if stats_from is None else stats_from, host_col, limit).withColumnRenamed("host", PRE + "host")
    rows = replace_columns(featured, "base_failed", "kept").withColumn(PRE + "host", F.col(host_col))
    rows = checked_join(rows, bad.withColumn(PRE + "bad", F.lit(True)), [PRE + "host"], "left")
    return rows.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & F.col(PRE + "bad").isNull()}).drop(PRE + "host", PRE + "bad")


def oracle(limit: float = HOST_LIMIT) -> str:
    """DuckDB SQL of the same, from the definitions."""
    rules = {n: r.replace("word_chars", "f.word_chars") for n, r in RULES.items()}
    base = " or ".join(f"({RULES[r]})" for r in BASE)
    stacked = " union all ".join(f"select source, '{n}' as rule, count(*) as n, sum(case when {r} then 1 else 0 end) as k from f where source is not null group by source" for n, r in rules.items())
    return f"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select r, unnest(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as word,
             generate_subscripts(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) as i from d),
g as (select r, i, case when lead(word, {WINDOW - 1}) over (partition by r order by i) is not null then
             concat_ws(' ', word, {", ".join(f"lead(word, {k}) over (partition by r order by i)" for k in range(1, WINDOW))}) end as gram from w),
t as (select r, i, gram is not null and count(*) over (partition by r, gram) > 1 as twice from g),
c as (select r, i, max(case when twice then i else -{WINDOW} end) over (partition by r order by i rows between {WINDOW - 1} preceding and current row) >= 0 as covered from t),
wc as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
rc as (select r, sum(case when covered then 1 else 0 end) as n_repeat_words from c group by r),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
lc as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
f as (select doc_id, source, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from d left join wc using (r) left join rc using (r) left join lc using (r)),
k as ({stacked}),
p as (select rule, avg(k / n) as mean, var_pop(k / n) as variance from k group by rule),
s as (select source, (k + mean * strength) / (n + strength) as shrunk from k join
      (select rule, mean, case when variance > 0 then greatest({WEAKEST}, least({STRONGEST}, mean * (1 - mean) / variance - 1)) else {STRONGEST} end as strength from p) using (rule)),
b as (select distinct source from s where shrunk > {limit})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed,
       not ({base}) and (source is null or source not in (select source from b)) as kept
from f"""
