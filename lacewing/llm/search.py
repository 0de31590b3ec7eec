"""Ranked lexical search: the documents that score highest for each query text, by groups of documents that hold the same of its terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.functions.lineage import stored
from lacewing.llm.common import PRE, cut

#: Bytes that are part of a term as they are or, A to Z, in lower case; all others stand between terms.
_KEPT = {i: i for i in range(256) if re.match(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", bytes([i]))}
FOLDED = bytes(_KEPT[i] + 32 * (65 <= i <= 90) if i in _KEPT else 32 for i in range(256))
#: Query texts are taken in blocks of so many bytes, whose terms each task holds.
BLOCK_BYTES = 4 << 20
#: Documents whose postings are scored together, and groups that are scored before the bound is looked at again.
DOCS, GROUPS = 4096, 64
#: Parts in which a query's best documents are thinned out before they meet.
PARTS = 64


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, with repeats; none of null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


def profiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): a document's number of terms, and those of the vocabulary (broadcast) with their counts; no row without a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        for batch in batches:
            for start in range(0, len(batch), DOCS):
                rows = []
                for doc, text in zip(batch["doc_id"].array[start : start + DOCS], batch["text"].array[start : start + DOCS], strict=True):
                    found = terms(text)
                    if found:
                        own = [(number[t], k) for t, k in Counter(found).items() if t in number]
                        rows.append((None if pd.isna(doc) else int(doc), len(found), [t for t, _ in own], [k for _, k in own]))
                yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "n": pd.array([r[1] for r in rows], "int64"), "terms": [r[2] for r in rows], "counts": [r[3] for r in rows]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, terms array<int>, counts array<long>")


def weight(n_docs: int, holding: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)


class Postings:
    """A batch of profiles by term: documents in which each term is, and its impact there."""

    def __init__(self, batch: pd.DataFrame, n_docs: int, n_terms: int):
        sizes = np.array([len(x) for x in batch["terms"]], np.int64)
        doc = np.repeat(np.arange(len(batch)), sizes)
        term = np.concatenate([np.asarray(x, np.int64) for x in batch["terms"]]) if len(batch) else np.empty(0, np.int64)
        tf = np.concatenate([np.asarray(x, np.int64) for x in batch["counts"]]) if len(batch) else np.empty(0, np.int64)
        m = 25 + 75 * batch["n"].to_numpy(np.int64) * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.size = len(batch)
        self.held, self.begin = np.unique(term[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))

    def of(self, term: int) -> slice:
        i = int(np.searchsorted(self.held, term))
        return slice(int(self.begin[i]), int(self.end[i])) if i < len(self.held) and self.held[i] == term else slice(0, 0)


def grouped(postings: Postings, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(masks, group): the distinct masks of the query's terms that documents hold, as 64-bit words, and each document's mask among them."""
    words = -(-len(query) // 64)
    masks = np.zeros((postings.size, words), np.uint64)
    for j, term in enumerate(query):
        masks[postings.doc[postings.of(term)], j // 64] |= np.uint64(1 << (j % 64))
    keys = masks[:, 0] if words == 1 else np.ascontiguousarray(masks).view(f"V{8 * words}").ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return masks[first], group.ravel()


def best(postings: Postings, ids: np.ndarray, query: np.ndarray, weights: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best documents of held ones and the batch's, equal scores by id.

    A mask's documents score at most the sum of its terms' largest impacts in the batch. Masks are gone through from the largest such bound
    on, until the k-th best score so far is above the bound of all that are left.
    """
    pieces = [postings.of(t) for t in query]
    if not any(p.stop > p.start for p in pieces):
        return held
    masks, group = grouped(postings, query)
    top = np.array([postings.impact[p].max() if p.stop > p.start else 0 for p in pieces], np.int64) * weights
    bound = np.zeros(len(masks), np.int64)
    for j in range(len(query)):
        bound += np.where(masks[:, j // 64] >> np.uint64(j % 64) & np.uint64(1) == 1, top[j], 0)
    order = np.argsort(-bound, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = np.argsort(place[group], kind="stable")
    starts = np.searchsorted(place[group][docs], np.arange(len(order) + 1))
    scores, found, at, step = *held, 0, GROUPS
    while at < len(order):
        limit = bound[order[at]]
        if limit <= 0 or len(scores) >= k and scores[k - 1] > limit:
            break
        chosen = docs[starts[at] : starts[min(at + step, len(order))]]
        at, step = at + step, 2 * step
        where = np.full(postings.size, -1)
        where[chosen] = np.arange(len(chosen))
        own = np.zeros(len(chosen), np.int64)
        for p, w in zip(pieces, weights, strict=True):
            to = where[postings.doc[p]]
            own[to[to >= 0]] += w * postings.impact[p][to >= 0]
        scores, found = np.append(scores, own[own > 0]), np.append(found, ids[chosen][own > 0])
        kept = np.lexsort((found, -scores))[:k]
        scores, found = scores[kept], found[kept]
    return scores, found


def block_results(docs: DataFrame, items: list[tuple[int, str | None]], k: int) -> DataFrame:
    """(item, doc_id, score) of the k best documents in each task for each of some query texts, which are broadcast."""
    vocabulary: dict[bytes, int] = {}
    queries = []
    for item, text in items:
        own = Counter(terms(text))
        queries.append((item, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in own], np.int64), np.array(list(own.values()), np.int64)))
    rows = stored(profiles(docs, vocabulary))
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # a row a term of the block
        holding[r.t] = r.df
    w = weight(n_docs, holding)
    shared = docs.sparkSession.sparkContext.broadcast([(item, q, w[q] * r) for item, q, r in queries])
    none, least = np.empty(0, np.int64), np.iinfo(np.int64).min

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {item: (none, none) for item, _, _ in shared.value}
        for batch in batches:
            for start in range(0, len(batch), DOCS):
                part = batch.iloc[start : start + DOCS]
                postings = Postings(part, n_docs, n_terms)
                ids = np.array([least if pd.isna(x) else int(x) for x in part["doc_id"].array], np.int64)  # null before all
                for item, query, weights in shared.value:
                    held[item] = best(postings, ids, query, weights, k, held[item])
        out = [(item, None if doc == least else int(doc), int(score)) for item, (scores, found) in held.items() for score, doc in zip(scores, found, strict=True)]
        yield pd.DataFrame({"item": [x[0] for x in out], "doc_id": pd.array([x[1] for x in out], "Int64"), "score": [x[2] for x in out]}).astype({"item": "int64", "score": "int64"})

    return rows.mapInPandas(run, "item long, doc_id long, score long")


def block_of(n: int) -> Column:
    return F.pmod(F.xxhash64(PRE + "item"), F.lit(n))


def blocks(items: DataFrame) -> int:
    """Number of blocks so that none has more than about BLOCK_BYTES of query texts, unless a single text has."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    n = 1 + (items.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES
    while True:
        worst = items.groupBy(block_of(n).alias("b")).agg(F.sum(size).alias("s"), F.count("*").alias("c")).where(f"s > {2 * BLOCK_BYTES} and c > 1")
        if not worst.head(1):
            return n
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, with a score above 0; equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Terms are maximal runs of letters and digits and of all characters beyond ASCII, only A-Z
    lower-cased. Let N be the number of documents with a term, L that of all their terms, df that of documents holding a term, n a document's
    number of terms and m = 25 + ((75 n N) div L). A document's score sums w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats
    included, with w = floor(1000 ln((2 N + 2) / (2 df + 1))).

    Null and empty texts have no terms: such documents count nowhere and such items have no results. Null ids are allowed; a null doc_id comes
    before others of its score. Repeated rows are documents, and items, each for themselves. An empty table gives no rows.

    Each task turns its documents into postings of the items' terms and keeps the k best of each item, so what meets is k rows an item and task, thinned out in PARTS
    first. Items are taken in blocks of BLOCK_BYTES, against all documents each.
    """
    numbered = cut(items.select("item_id", "text", F.monotonically_increasing_id().alias(PRE + "item")))
    out = None
    for b in range(n := blocks(numbered)):
        block = [(r[0], r[1]) for r in numbered.where(block_of(n) == b).select(PRE + "item", "text").toLocalIterator()]
        found = block_results(docs, block, k) if block else None
        out = found if out is None else out if found is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    thinned = out.withColumn(PRE + "part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", PRE + "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    named = numbered.select("item_id", F.col(PRE + "item").alias("item"))
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_TERMS} as ts from documents where text is not null), sized as (select doc_id, ts, len(ts)::bigint as n from d where len(ts) > 0),
totals as (select count(*)::bigint as nn, sum(n)::bigint as ll from sized),
wanted as (select item_id, term, count(*)::bigint as reps from (select item_id, unnest({_TERMS}) as term from benchmark where text is not null) group by 1, 2),
held as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(ts) as term from sized) where term in (select term from wanted) group by 1, 2, 3),
weights as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, totals group by term, nn),
scored as (select item_id, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::bigint as score from wanted join weights using (term) join held using (term), totals group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""
