"""Queries of the training-data problems tagged llm (p5 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import encode, entity_match, lookalike, packing
from tallyweave.session import table


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bank_id, book_id, confidence) of entries that record the same movement."""
    found = entity_match.match(table(spark, sf_dir, "bank_entry"), table(spark, sf_dir, "book_entry"))
    return found.select(F.col("id_a").alias("bank_id"), F.col("id_b").alias("book_id"), F.round("confidence", 6).alias("confidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_a, entry_b): entries that record the same movement, smaller id first."""
    found = p5_matches(spark, sf_dir)
    return found.select(F.least("bank_id", "book_id").alias("entry_a"), F.greatest("bank_id", "book_id").alias("entry_b"))


def _vocabulary(spark: SparkSession) -> str:
    """The tokenizer's file: the session setting tallyweave.vocabulary, or the public one."""
    return spark.conf.get("tallyweave.vocabulary", encode.VOCABULARY)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode.encode_texts(table(spark, sf_dir, "documents"), vocabulary=_vocabulary(spark))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece_no, tokens, container_id) of every document in containers of 2,048 tokens."""
    return packing.pack(encode.count_tokens(table(spark, sf_dir, "documents"), vocabulary=_vocabulary(spark)))


def p7_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by each method, the one used, and the lower bound."""
    return packing.methods(encode.count_tokens(table(spark, sf_dir, "documents"), vocabulary=_vocabulary(spark)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_a, doc_b): documents that look the same but are not equal."""
    return lookalike.same_look(table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, look_id, text_id, spellings): the class of each document's look and of its text."""
    return lookalike.look_classes(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, form): the one form of every document's text."""
    return lookalike.one_form(table(spark, sf_dir, "documents")).select("doc_id", "form")


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_methods": p7_methods, "p8_found": p8_found, "p8_classes": p8_classes, "p8_forms": p8_forms}
ORACLE: dict[str, str] = {}
