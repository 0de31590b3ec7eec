"""The opN_ queries themselves, over whole tables with nulls and repeated texts added, against independent computation."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from lacewing.llm import queries
from pyspark.sql import functions as F

from test_llm import ASSIGN, classes_by_brute_force, reference, vocabulary  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with null, empty and repeated texts and a further column."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = F.when(F.col("doc_id") % 41 == 3, None).when(F.col("doc_id") % 41 == 4, "").when(F.col("doc_id") % 41 == 5, docs.orderBy("doc_id").first().text).otherwise(F.col("text"))
    docs.withColumns({"text": text, "size": F.lit("mine"), "fingerprint": F.lit(1)}).write.parquet(f"{out}/documents.parquet")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = F.when(F.col("page_id") % 17 == 3, None).when(F.col("page_id") % 5 == 1, F.repeat(F.lit("same "), 300)).otherwise(F.col("html"))
    pages.withColumn("html", html).write.parquet(f"{out}/pages.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def by_id(df):
    rows = df.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_op1(spark, folder, texts, reference):  # noqa: F811
    got = by_id(queries.op1_bpe(spark, folder))
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = reference.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op2(spark, folder, texts):
    got, loads = by_id(queries.op2_sharding(spark, folder)), Counter()
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert (got[i].size, got[i].text_crc32, got[i].grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), None)
        loads[got[i].shard] += got[i].size
    for s in range(16):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))
    assert max(loads.values()) <= 1.1 * sum(loads.values()) / 16 + max(r.size for r in got.values())


def test_op4(spark, folder, texts):
    got = by_id(queries.op4_secrets(spark, folder))
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        assert set(filter(None, shown.split(","))) <= set(got[i].spans.split(","))


@pytest.mark.parametrize("name", ["op6_warc", "op7_quality"])
def test_oracles(spark, folder, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, expected = queries.QUERIES[name](spark, folder), duck.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    rows = lambda names, found: sorted([tuple(str(r[names.index(c)]) for c in order) for r in found])
    assert rows(got.columns, got.collect()) == rows(expected.columns, expected.fetchall())
    if name == "op6_warc":
        assert Counter(r.record_type for r in got.collect())["revisit"] > 3


def test_op8(spark, folder, texts):
    got, order = by_id(queries.op8_simhash(spark, folder)), sorted(texts)
    prints, roots = classes_by_brute_force([texts[i] for i in order])
    assert [(got[i].fingerprint, got[i].component_id) for i in order] == [(f"{p:016x}", order[r]) for p, r in zip(prints, roots, strict=True)]


def test_op9(spark, folder, texts):
    got = by_id(queries.op9_mixing(spark, folder))
    assert set(got) == set(texts)
    for i, text in texts.items():
        size = len(words(text))
        assert got[i].size == size and 0 <= got[i].taken <= 3 * size and (size == 0 or got[i].taken % size == 0)
    again = by_id(queries.op9_mixing(spark, folder))
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()}


def test_op10(spark, folder, texts):
    got, same = by_id(queries.op10_media(spark, folder)), {}
    for i, text in texts.items():
        data = text.encode()
        padded = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        counts = Counter(b // 32 for b in padded)
        assert sum(int(n) for f in r.feature.split("+") for n in f.split(":")[3].split(",")) >= 3 * sum(counts.values())
        assert same.setdefault(text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
