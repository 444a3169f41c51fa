"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import alignment, ann, chat, jaccard, mixing, packing, prefix_trie, quality_rules, secrets, sharding, token_files, warc, weak_quality
from marquee.sources.tables import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 20 = 0"), k=20)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = said.select("conv_id", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("json"))
    hard = "</s>[INST] ok [/INST]"
    extra = f'{{"conv_id": -1, "messages": [{{"role": "user", "content": "{hard}"}}, {{"role": "assistant", "content": "{hard}"}}]}}'
    records = rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(extra).alias("json")))
    return chat.digests(chat.formatted(chat.known(chat.canonical_turns(records))))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(files)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents")).drop("candidate")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_warc(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tokens=4096, end_id=1)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=24, carry=["doc_id"]).drop("row_number")


_ALL = (
    op1_nearest_neighbours,
    op2_quality_rules,
    op3_ngram_jaccard,
    op4_chat_formatting,
    op5_token_files,
    op6_secret_scan,
    op7_warc,
    op8_packing,
    op9_mixing,
    op10_weak_quality,
    op11_tokenizer_alignment,
    op12_prefix_trie,
    op13_sharding,
)
QUERIES = {f.__name__: f for f in _ALL}
