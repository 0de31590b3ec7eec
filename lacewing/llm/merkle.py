"""A Merkle manifest of a dataset: a tree over each source's records, a tree over the sources, and a proof for every record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.llm.common import BROADCAST_ROWS, PRE, checked_join, cut

#: Children of a node.
FAN = 16
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_TREE, _AT, _N, _DIGEST, _RUN = PRE + "tree", PRE + "at", PRE + "n", PRE + "digest", PRE + "run"


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column] | None = None) -> Column:
    """SHA-256 of a record's fields as 32 bytes; fields: other values than the columns' own."""
    values = {name: F.col(f"`{name}`") for name in FIELDS} | (fields or {})
    return F.unhex(F.sha2(F.concat(*[encoded(values[name]) for name in FIELDS]), 256))


def digest_of(*digests: Column) -> Column:
    """SHA-256 of digests joined as lower-case hex text, as 32 bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*digests))), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with their place (from 0) within their group (columns without nulls) by order, nulls first, and the group's size.

    Rows are dealt to ranges of (group, order) and counted there; only these counts are summed over a group, so no group is in one task. Rows
    that are equal in all of them are spread over ranges too, and stand in any order.
    """
    part, spread = PRE + "part", PRE + "spread"
    dealt = rows.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*group, *order, spread)
    dealt = cut(dealt.drop(spread).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(*group, part).agg(F.count("*").alias(PRE + "k"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, part, F.coalesce(F.sum(PRE + "k").over(upto), F.lit(0)).alias(PRE + "before"), F.sum(PRE + "k").over(whole).alias(_N))
    own = F.row_number().over(Window.partitionBy(*group, part).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    placed = checked_join(dealt.withColumn(PRE + "own", own), counts, [*group, part], "inner")
    return placed.select(*rows.columns, (F.col(PRE + "before") + F.col(PRE + "own") - 1).alias(_AT), _N)


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, at, n, digest, ...) of one level with their run of FAN nodes and the digests before and after them in it, joined.

    Siblings come from lag and lead columns of fixed offsets: a lag is there from that slot on, a lead within the run's length.
    """
    run, slot = F.expr(f"{_AT} div {FAN}"), F.col(_AT) % FAN
    nodes = nodes.withColumn(_RUN, run)
    order = Window.partitionBy(_TREE, _RUN).orderBy(_AT)
    length = F.least(F.lit(FAN), F.col(_N) - F.col(_RUN) * FAN)
    none = F.lit(b"")
    lags = [F.when(slot >= k, F.lag(_DIGEST, k).over(order)).otherwise(none) for k in range(FAN - 1, 0, -1)]
    leads = [F.when(slot + k < length, F.lead(_DIGEST, k).over(order)).otherwise(none) for k in range(1, FAN)]
    return nodes.withColumns({PRE + "left": F.concat(*lags), PRE + "right": F.concat(*leads)})


def parents(level: DataFrame) -> DataFrame:
    """The nodes above a level: the first child of each run hashes it."""
    first = level.where(F.col(_AT) % FAN == 0)
    return first.select(_TREE, F.col(_RUN).alias(_AT), F.ceil(F.col(_N) / FAN).alias(_N), digest_of(F.col(_DIGEST), F.col(PRE + "right")).alias(_DIGEST))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Levels of trees (tree, at, n, digest), the leaves first, until each tree has one node."""
    levels = [nodes]
    left = nodes.agg(F.max(_N)).first()[0] or 0
    while left > 1:
        levels.append(cut(parents(with_siblings(levels[-1].where(F.col(_N) > 1)))))
        left = -(-left // FAN)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the node that remains of each tree."""
    found = [level.where(F.col(_N) == 1).select(_TREE, _DIGEST) for level in levels]
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    return whole


def below(level: DataFrame, above: DataFrame, tops: DataFrame, keep: list[str]) -> DataFrame:
    """A level's nodes with their path: the digests left and right of them and of each node above. above: the next level's paths; tops: those of roots."""
    inner = with_siblings(level.where(F.col(_N) > 1)).join(above.withColumnRenamed(_AT, _RUN), [_TREE, _RUN])
    own = F.array(F.struct(F.col(PRE + "left").alias("left"), F.col(PRE + "right").alias("right")))
    inner = inner.select(_TREE, _AT, *keep, F.concat(own, PRE + "path").alias(PRE + "path"))
    alone = checked_join(level.where(F.col(_N) == 1).select(_TREE, _AT, *keep), tops, [_TREE], "inner")
    return inner.unionByName(alone.select(_TREE, _AT, *keep, PRE + "path"))


def paths(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """The leaves (tree, at, ...) with their paths, from the top down; only nodes above the leaves are stored with theirs."""
    at = tops.limit(0).select(_TREE, F.lit(0).cast("long").alias(_AT), PRE + "path")
    for level in reversed(levels[1:]):
        at = cut(below(level, at, tops, []))
    return below(levels[0], at, tops, keep)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda at, x: digest_of(x["left"], at, x["right"]))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every record.

    A record's leaf hashes its FIELDS. In each source leaves ascend by doc_id; while a source has several nodes, every 16 consecutive ones become
    their hash, the last run having fewer. What remains is the source's subroot; subroots in order of the source (null first, then by bytes) give the root
    likewise. A record's proof is the list of its siblings, level by level, which proof_sha256 hashes. folded_root is recomputed from the record's present
    text (tampered_text, if given, else as manifested) and its proof; verified says whether it is the root.

    Nulls in any column are allowed; a null doc_id comes first in its source. Repeated ids are records each, in order of their leaves, and so are repeated
    rows. Other columns are ignored. An empty table gives none. Texts are read once, for their digests, and never shuffled. The order within a source comes from
    ranges, runs have 16 rows at most, and paths are handed from parents to children, so neither a source with most rows nor the number of sources matters to a task.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in FIELDS])
    now = leaf_digest() if tampered_text is None else F.unhex(F.sha2(F.concat(*[encoded(tampered_text if c == "text" else F.col(c)) for c in FIELDS]), 256))
    leaves = cut(rows.select("doc_id", "source", leaf_digest().alias(_DIGEST), now.alias(PRE + "now")))
    sources = numbered(leaves.select("source").distinct(), [], ["source"])
    sources = cut(sources.select(F.col("source").alias(PRE + "source"), F.col(_AT).alias(_TREE)))
    sources = F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources
    named = leaves.join(sources, F.col("source").eqNullSafe(F.col(PRE + "source"))).drop("source", PRE + "source")
    nodes = cut(numbered(named, [_TREE], ["doc_id", _DIGEST]))
    levels = grown(nodes)
    subroots = cut(roots(levels))
    n = subroots.count()
    over = grown(subroots.select(F.lit(0).cast("long").alias(_TREE), F.col(_TREE).alias(_AT), F.lit(n).cast("long").alias(_N), _DIGEST))
    root = roots(over).select(F.col(_DIGEST).alias(PRE + "root"))
    nothing = subroots.sparkSession.range(1).select(F.col("id").alias(_TREE), F.array().cast("array<struct<left:binary,right:binary>>").alias(PRE + "path"))
    tops = cut(paths(over, nothing, [_DIGEST]).select(F.col(_AT).alias(_TREE), PRE + "path", F.col(_DIGEST).alias(PRE + "sub")))
    proven = paths(levels, tops.select(_TREE, PRE + "path"), ["doc_id", _DIGEST, PRE + "now"])
    proven = checked_join(proven, tops.select(_TREE, PRE + "sub"), [_TREE], "inner").withColumn(PRE + "root", cut(root).scalar())
    siblings = F.aggregate(PRE + "path", F.lit(b""), lambda at, x: F.concat(at, x["left"], x["right"]))
    proven = proven.withColumn(PRE + "folded", folded(F.col(PRE + "now"), F.col(PRE + "path")))
    return proven.select(
        "doc_id",
        shown(F.col(_DIGEST)).alias("leaf"),
        shown(F.col(PRE + "sub")).alias("subroot"),
        shown(F.col(PRE + "root")).alias("root"),
        F.sha2(shown(siblings), 256).alias("proof_sha256"),
        shown(F.col(PRE + "folded")).alias("folded_root"),
        (F.col(PRE + "folded") == F.col(PRE + "root")).alias("verified"),
    )


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampering() -> Column:
    """The text as it is found later: where 5 divides the CRC-32 of the decimal doc_id, its A-Z are in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))


def oracle(levels: int = 6, over: int = 4) -> str:
    """DuckDB SQL of the query, for sources of up to 16 ** levels records and 16 ** over sources."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in FIELDS[:-1])} || {field(text)})"
    step = "list_reduce(range(0, 8), lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end, {})"
    crc = f"xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint), lambda c, b: {step.format('xor(c, b)')}, 4294967295::bigint), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    views = [
        f"read as (select *, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {lower} else text end as later from documents)",
        f"d0 as (select row_number() over () as k, doc_id, source, leaf, {leaf('later')} as h, '' as proof, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as spot from read)",
        "t0 as (select source, spot, leaf as h, count(*) over (partition by source) as n from d0)",
    ]

    def level(i: int, j: int) -> None:
        ends = "string_agg(h, '') over (partition by source, spot // 16 order by spot rows between {} and {})"
        sides = f"coalesce({ends.format('unbounded preceding', '1 preceding')}, '') as l, coalesce({ends.format('1 following', 'unbounded following')}, '') as r"
        views.append(f"s{i} as (select *, {sides} from t{i})")
        views.append(f"d{j} as (select d.* replace (case when n = 1 then d.h else sha256(l || d.h || r) end as h, case when n = 1 then proof else proof || l || r end as proof, d.spot // 16 as spot) from d{i} d join s{i} s on d.source is not distinct from s.source and d.spot = s.spot)")
        views.append(f"t{j} as (select source, spot // 16 as spot, case when n = 1 then h else sha256(h || r) end as h, (n + 15) // 16 as n from s{i} where spot % 16 = 0)")

    for i in range(levels):
        level(i, i + 1)
    i = levels + 1
    views.append(f"subs as (select source, h as subroot, row_number() over (order by source is not null, source) - 1 as spot from t{levels})")
    views.append(f"d{i} as (select d.* replace ('all' as source, s.spot as spot), subroot from d{levels} d join subs s on d.source is not distinct from s.source)")
    views.append(f"t{i} as (select 'all' as source, spot, subroot as h, count(*) over () as n from subs)")
    for j in range(i, i + over):
        level(j, j + 1)
    last = i + over
    return f"with {', '.join(views)} select doc_id, leaf, subroot, t.h as root, sha256(proof) as proof_sha256, d.h as folded_root, d.h = t.h as verified from d{last} d, t{last} t"


ORACLE = oracle()
