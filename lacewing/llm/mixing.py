"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacewing.llm.common import PRE, checked_join, cut, n_words, put_aside, put_back, replace_columns

#: Weights of the sources in their order, repeating; copies of a document at most; share of all sizes that is dealt out.
WEIGHTS, MOST, SHARE = (5, 2, 1), 3, 1.0
#: Parts into which documents of one source and size are dealt by a hash of their id, to be numbered apart.
PARTS = 64

_SOURCE, _SIZE, _PART = PRE + "source", "size", PRE + "part"


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = SHARE, seed: int = 0) -> DataFrame:
    """(source key, source_size, target, rate, offset) of each source of rows with the columns size and source key.

    Sources are in order of code points, null last, and weigh as WEIGHTS says. Targets share the sizes' total by weight, but stop at
    `most` times their source's size; what is above goes to the others by weight until none is above. That is target = min(cap,
    level * weight) with one level for all: with sources by cap / weight, the first at which the level of those from it on is within its
    own cap fixes the level. This is a table of one row a source; the rows were summed before.
    """
    sources = sized.groupBy(_SOURCE).agg(F.sum(_SIZE).alias("source_size"))
    everything = Window.partitionBy()
    order = F.row_number().over(everything.orderBy(F.col(f"{_SOURCE}.missing"), F.col(f"{_SOURCE}.name"))) - 1
    sources = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), order % len(weights)))
    sources = sources.withColumns({"cap": most * F.col("source_size").cast("double"), "total": share * F.sum("source_size").over(everything).cast("double")})
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col(_SOURCE))
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - before) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", level)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    sources = sources.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("cap") / F.col("weight"))).over(everything))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col(f"{_SOURCE}.name"), F.col(f"{_SOURCE}.missing")), F.lit(1 << 40)) / float(1 << 40)
    sources = sources.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.select(_SOURCE, "source_size", "target", rate.alias(PRE + "rate"), offset.alias(PRE + "offset"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """Add size (words), source_size, target (its source's) and copies, how often the mix takes the row.

    Within a source each document is expected rate = target / size of the source times. With documents ordered by size, then by parts and
    hashes, and one random offset for each source, a document is taken once for each integer that the prefix sum of expected copies, begun at
    the offset, crosses in it; in order of size, what is taken of each source comes within about a document of its target. Seeded, so
    reruns agree. Null or blank texts have size 0; rows with a null source are a source of their own; null ids are allowed; repeated rows are documents
    each; existing columns of these names are replaced; an empty table gives an empty one.

    Prefix sums take three levels, so that a source with most rows, or with most rows of one size, is never in one task: sizes within a
    source, parts within a size, rows within a part. Only counts are summed over the first two.
    """
    df = replace_columns(df, _SIZE, "source_size", "target", "copies")
    key = F.struct(F.col(source_col).isNull().alias("missing"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(PARTS)).cast("int")
    order = F.struct(F.xxhash64(F.lit(seed + 1), F.col(id_col)).alias("id"), F.xxhash64(F.col(text_col)).alias("text"))
    sized = df.withColumns({_SOURCE: key, _SIZE: n_words(F.col(text_col)), _PART: part, PRE + "order": order})
    cells = cut(sized.groupBy(_SOURCE, _SIZE, _PART).agg(F.count("*").alias("n")))
    dealt = targets(cells.select(_SOURCE, (F.col(_SIZE) * F.col("n")).alias(_SIZE)), seed=seed)
    sizes = cells.groupBy(_SOURCE, _SIZE).agg(F.sum("n").alias("m"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("m").over(earlier(Window.partitionBy(_SOURCE).orderBy(_SIZE))), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(earlier(Window.partitionBy(_SOURCE, _SIZE).orderBy(_PART))), F.lit(0))
    places = checked_join(cells.withColumn("inner", inner), sizes.drop("m"), [_SOURCE, _SIZE], "inner")
    places = checked_join(places, dealt, [_SOURCE], "inner").withColumn(PRE + "first", F.col("first") + F.col("inner")).drop("n", "first", "inner")
    rows = sized.join(cut(places), [_SOURCE, _SIZE, _PART])
    within = Window.partitionBy(_SOURCE, _SIZE, _PART).orderBy(PRE + "order", F.col(id_col))
    at = F.col(PRE + "first") + F.row_number().over(within)
    crossed = lambda x: F.floor(x * F.col(PRE + "rate") + F.col(PRE + "offset"))
    rows = rows.withColumn(PRE + "at", at).withColumn("copies", (crossed(F.col(PRE + "at")) - crossed(F.col(PRE + "at") - 1)).cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], _SIZE, "source_size", "target", "copies")


def mixture(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, with the columns of df, whatever their names; see mix() for nulls and repeated rows."""
    aside = put_aside(df, _SIZE, "source_size", "target", "copies")
    taken = mix(aside, **options).where("copies > 0")
    out = taken.withColumn(PRE + "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return put_back(out.select(*[F.col(f"`{c}`") for c in aside.columns]), df)
