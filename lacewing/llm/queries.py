"""The numbered operators as queries over the given tables, each a thin digest of what its operator returns."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.llm import bpe, chat, extraction, lines, media, merkle, mixing, quality, search, secrets, sharding, simhash, warc
from lacewing.llm.common import cut

#: The vocabulary of op1 and of the pipeline's last stage.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> bytes:
    return Path(public_tokenizers.path(VOCABULARY)).read_bytes()


def encoded(docs: DataFrame) -> DataFrame:
    """Documents' token ids and the text decoded from them, as digests."""
    out = bpe.round_trip(docs.select("doc_id", "text"), vocabulary(), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole document, and back."""
    return encoded(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes; equal texts have one key."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = cut(documents(spark, sf_dir).select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    out = sharding.shard(rows, 16, F.col("key"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that another one has, or nearly has."""
    return lines.deduplicate_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    found = secrets.find_secrets(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda x: x["kind"] < 3))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])]
    base = F.sha2(secrets.shown(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secrets.shown(F.col("spans")).alias("spans"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged conversations, collapsed and rendered."""
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; equal payloads are written once."""
    folder = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    number = lambda c: F.expr(f"cast(nullif(substr({c}, {len('urn:page:') + 1}), '') as bigint)")
    found = warc.read_warc(spark, folder, payloads=False)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of every whole document, and verdicts that join in its host's."""
    featured = cut(quality.features(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("text"))
    return quality.judge(featured).drop("source", "n_lines")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' weights."""
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as the frames of a GIF, read back; the feature lists each frame's time, size and colours."""
    rows = media.payloads(documents(spark, sf_dir).select("doc_id", "text"))
    stored = media.read_gif(media.store_gif(rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "payload")).drop("payload"))
    read = F.col("gif.samples")
    shown = lambda f: F.concat_ws(":", *[f[c].cast("string") for c in ("delay", "width", "height")], F.array_join(f["histogram"].cast("array<string>"), ","))
    feature = F.array_join(F.transform("gif.frames", shown), "+")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length(read).cast("long").alias("payload_bytes"), F.sha2(read, 256).alias("payload_sha256"), F.crc32(F.substring(read, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents, and what their proofs say when some texts have been changed."""
    return merkle.manifest(documents(spark, sf_dir), merkle.tampering())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_lines": op3_lines,
    "op4_secrets": op4_secrets,
    "op5_chat": op5_chat,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
    "op11_search": op11_search,
    "op12_extraction": op12_extraction,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op5_chat": chat.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_quality": quality.oracle(),
    "op11_search": search.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
