"""What bounds the memory of executors, workers and driver between an operator's steps."""

from __future__ import annotations

import base64
import glob
import random
import tempfile
import time

import pyarrow as pa
import pytest
from lacewing.functions import lineage
from lacewing.llm import bpe, common, lines, shingles

BYTES = {bytes([i]): i for i in range(256)}


def largest_batch(spark) -> int:
    """Bytes of the largest Arrow batch that a worker is given of 8 MB of text in one partition."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return spark.range(4000).selectExpr("repeat('x', 2000) as text").coalesce(1).mapInArrow(sizes, "n long").groupBy().max("n").first()[0]


@pytest.mark.parametrize("operator", ["bpe", "lines", "shingles"])
def test_workers_are_given_small_batches(spark, operator):
    spark.conf.unset(common.BATCH_SETTING)
    try:
        assert largest_batch(spark) > 7 << 20
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
        if operator == "bpe":
            vocabulary = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in BYTES.items())
            bpe.encode(docs, vocabulary, r"\S+|\s+")
        else:
            {"lines": lines.deduplicate_lines, "shingles": shingles.deduplicate}[operator](docs)
        assert largest_batch(spark) < 5 << 20
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_a_limit_of_the_session_stays(spark):
    spark.conf.set(common.BATCH_SETTING, "1m")
    try:
        common.small_batches(spark)
        assert spark.conf.get(common.ROWS_SETTING) == "512"
        assert spark.conf.get(common.BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_shuffles_of_tables_that_are_gone_are_dropped(spark):
    """The files of a finished shuffle go once they are asked for; the driver's own garbage collection may be half an hour away."""
    root = spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()
    files = lambda: set(glob.glob(f"{root}/**/blockmgr-*/*/shuffle_*", recursive=True))
    before = files()
    spark.range(1000).repartition(7).write.format("noop").mode("overwrite").save()
    own = files() - before
    assert own
    for _ in range(20):  # what the last job has used stays until there is another
        spark.range(10).count()
        lineage.released(spark)
        time.sleep(0.3)
        if not own & files():
            break
    assert not own & files()


def test_rounds_of_the_second_comparison_have_plans_of_one_size(spark, monkeypatch):
    """A round's pairs are a table; its plan doesn't hold those of the rounds before."""
    sizes, close = [], lines._close

    def watched(pairs, of):
        sizes.append(pairs._jdf.queryExecution().analyzed().toString().count("Join"))
        return close(pairs, of)

    monkeypatch.setattr(lines, "_close", watched)
    monkeypatch.setattr(lines, "MOST_PAIRS", (1, 2))
    rnd, base = random.Random(8), [f"w{k}" for k in range(40)]
    texts = [" ".join(w if rnd.random() < 0.93 else f"x{rnd.randrange(10**6)}" for w in base) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines.deduplicate_lines(docs).count()
    assert len(sizes) > 2 and max(sizes) == 0
