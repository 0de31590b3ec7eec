"""Secret scans: fixed forms, and long tokens that a Markov model of random strings explains better than one of ordinary
identifiers. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacewing.llm.common import PRE, cut, replace_columns

# The forms that are always reported, in the order in which kinds of one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge: runs of at least LONG of these characters, or of at least LEAST with a digit among them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST, LONG = 12, 20
CANDIDATE = f"(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{{LEAST},}}|[A-Za-z0-9+/_=-]{{{LONG},}}"
#: Lengths from which a limit of its own is fitted; share of held-out ordinary tokens that may lie above it, and of random ones that must, for tokens of
#: that length to be judged; held-out tokens of either kind that a fit needs, and the limit of LONG tokens without one.
LENGTHS, FALSE, RECALL, ENOUGH, RATIO = (12, 16, 20, 32), 0.001, 0.9, 30, 0.25
#: Words of a training document that make one longer ordinary identifier.
JOINED = 4
#: Ordinary identifiers of the training sample: words of letters, perhaps joined by _ or -.
ORDINARY = r"\b[A-Za-z][a-z]{5,}(?:[_-][a-z]+)*\b"
#: Documents at most, in expectation, from which each of the two models is trained; weight of a character's own frequency against its transitions, and of even
#: chances within that; one token of so many is held out for the limits.
SAMPLE_DOCS, BACKOFF, EVEN, HELD = 2000, 5.0, 0.05, 4

_SPAN = "array<struct<at:int,kind:int,end:int,token:string>>"


def _spans(text: Column, kind: int, pattern: str, group: int, keep=None) -> Column:
    """Leftmost non-overlapping matches with their places: what split() leaves between the matches tells where they are."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    items = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), tokens.alias("token"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(a: Column, x: Column) -> Column:
        at = a["at"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        span = F.struct(at.alias("at"), F.lit(kind).alias("kind"), end.alias("end"), x["token"].alias("token"))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(items, start, add, lambda a: a["spans"])
    return F.when(text.rlike(pattern), F.filter(spans, keep) if keep else spans).otherwise(F.array().cast(_SPAN))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add, from whole texts, the spans of the fixed forms (column base) and the candidate tokens (column candidates).

    Null text counts as empty. One pass, no shuffle.
    """
    df = replace_columns(df, "base", "candidates")
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.when(text.contains("=") | text.contains(":"), _spans(text, 0, ASSIGN, 2, lambda x: F.length(x["token"]) >= ASSIGN_LEAST))
    access = F.when(text.contains("AKIA"), _spans(text, 1, ACCESS, 0))
    none = F.array().cast(_SPAN)
    base = F.concat(F.coalesce(assign, none), F.coalesce(access, none), _spans(text, 2, HEX, 0))
    return df.withColumns({"base": F.array_sort(base), "candidates": _spans(text, 3, CANDIDATE, 0)})


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, random over ordinary, from samples (token, random boolean).

    A model's chance of a transition comes from its count and, with the weight of BACKOFF counts, from the second character's frequency,
    so a model says something of characters it has rarely seen; without samples it is uniform. The result has a fixed size, the square
    of the alphabet's.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr(F.col("token"), i, F.lit(2))))
    rows = samples.where(F.length("token") > 1).select("random", pair.alias("pair")).groupBy("random", "pair").count()
    rows = rows.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()  # at most 2 x 67 x 67
    counts = {(r["random"], r["pair"]): r["count"] for r in rows}
    size, chance = len(ALPHABET), {}
    for kind in (True, False):
        whole = sum(n for (k, _), n in counts.items() if k == kind)
        seen = {b: sum(counts.get((kind, a + b), 0) for a in ALPHABET) / whole if whole else 1 / size for b in ALPHABET}
        single = {b: (1 - EVEN) * seen[b] + EVEN / size for b in ALPHABET}
        for a in ALPHABET:
            total = sum(counts.get((kind, a + b), 0) for b in ALPHABET) + BACKOFF
            for b in ALPHABET:
                chance[kind, a + b] = (counts.get((kind, a + b), 0) + BACKOFF * single[b]) / total
    return [math.log(chance[True, a + b] / chance[False, a + b]) for a in ALPHABET for b in ALPHABET]


def ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a token."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def add(a: Column, p: Column) -> Column:
        known = (a["last"] >= 0) & (p >= 0)
        return F.struct(p.alias("last"), (a["sum"] + F.when(known, F.get(table, a["last"] * len(ALPHABET) + p)).otherwise(0.0)).alias("sum"))

    return F.aggregate(places, start, add, lambda a: a["sum"]) / F.greatest(F.lit(1), F.length(token) - 1)


def labelled(docs: DataFrame, scanned: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples (token, random): values of the fixed forms are random, words of letters are ordinary.

    Both come from about sample_docs documents at most, drawn by a hash of the id: this bounds the training, whatever the input's size.
    """
    draw = lambda n: F.pmod(F.xxhash64(F.lit("secrets"), id_col), F.lit(1 << 30)) < int(min(1.0, sample_docs / max(n, 1)) * (1 << 30))
    hits = scanned.where(F.size("base") > 0)
    random = hits.where(draw(hits.count())).select(F.explode("base").alias("x")).select(F.col("x.token").alias("token"), F.lit(True).alias("random"))
    words = docs.where(draw(docs.count())).select(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(ORDINARY), F.lit(0)).alias("w"))
    joined = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / JOINED).cast("int")), lambda i: F.array_join(F.slice("w", i * JOINED + 1, JOINED), "_"))
    tokens = words.select(F.explode(F.concat("w", joined)).alias("token")).where("token <> ''")
    return random.unionByName(tokens.select("token", F.lit(False).alias("random")))


def held_out(token: Column) -> Column:
    """Whether a labelled token is kept from training."""
    return F.pmod(F.xxhash64(F.lit("held"), token), F.lit(HELD)) == 0


def limits(samples: DataFrame, ratios: list[float]) -> list[dict]:
    """By length: the ratio from which a token of at least that length counts as random (None: such tokens aren't judged), and what it does to held-out samples
    (token, random), cut to that length: n_random, n_ordinary, recall and false, the share of ordinary ones above it.

    The limit leaves FALSE of the ordinary ones above it. Lengths at which it finds less than RECALL of the random ones aren't judged; with fewer than
    ENOUGH samples of either kind only tokens of LONG characters are, by the limit of the length before, or else RATIO.
    """
    cuts = samples.select("random", "token", F.explode(F.array(*map(F.lit, LENGTHS))).alias("length")).where(F.length("token") >= F.col("length"))
    rows = cut(cuts.select("random", "length", ratio(F.substr("token", F.lit(1), F.col("length")), ratios).alias("r")))
    ordinary, random = F.when(~F.col("random"), F.col("r")), F.when(F.col("random"), F.col("r"))
    found = rows.groupBy("length").agg(F.count(random).alias("n_random"), F.count(ordinary).alias("n_ordinary"), F.percentile_approx(ordinary, 1 - FALSE, 100_000).alias("limit"))
    judged = rows.join(F.broadcast(found), "length").groupBy("length", "n_random", "n_ordinary", "limit")  # a row a length
    above = lambda x: F.avg((x > F.col("limit")).cast("double"))
    by_length = {r["length"]: r.asDict() for r in judged.agg(above(random).alias("recall"), above(ordinary).alias("false")).collect()}
    out = []
    for length in LENGTHS:
        r = by_length.get(length, {"length": length, "n_random": 0, "n_ordinary": 0, "limit": None, "recall": None, "false": None})
        if min(r["n_random"], r["n_ordinary"]) < ENOUGH:
            r["limit"] = None if length < LONG else out[-1]["limit"] if out and out[-1]["limit"] is not None else RATIO
        elif r["recall"] < RECALL:
            r["limit"] = None
        out.append(r)
    return out


def find(scanned: DataFrame, ratios: list[float], fitted: list[dict]) -> DataFrame:
    """Replace the columns of scan() by spans: array of (at, kind, end, token) by start, then kind as in KINDS.

    Offsets are code points, ends exclusive. A candidate is added as kind markov when its ratio is above the limit of its length (see limits) and it overlaps
    no span of a fixed form. Repeated rows get equal spans.
    """
    base = F.col("base")

    def random(token: Column) -> Column:
        limit = F.lit(None).cast("double")
        for r in fitted:  # by rising length
            limit = F.when(F.length(token) >= r["length"], F.lit(r["limit"]).cast("double")).otherwise(limit)
        return F.coalesce(ratio(token, ratios) > limit, F.lit(False))

    added = F.filter("candidates", lambda c: random(c["token"]) & ~F.exists(base, lambda b: (b["at"] < c["end"]) & (c["at"] < b["end"])))
    return replace_columns(scanned, "spans").withColumn("spans", F.array_sort(F.concat(base, added))).drop("base", "candidates")


def shown(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["at"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans of every row; texts are read once, and what the scan found is kept in the shared folder for training and scoring.

    Null text counts as empty; rows with a null or repeated id are scanned as any other; an empty table gives none. Other columns are
    left out, whatever their names.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    scanned = cut(scan(docs, text_col).drop(text_col))
    samples = cut(labelled(docs, scanned, id_col, text_col))
    ratios = train(samples.where(~held_out(F.col("token"))))
    return find(scanned, ratios, limits(samples.where(held_out(F.col("token"))), ratios))


