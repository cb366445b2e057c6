"""Queries pN_ of the text problems. None has a SQL counterpart: tests hold them against other implementations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .packing import pack_documents
from .residue import candidate_messages, classified_messages, residue_documents
from .tokenize import encode_corpus


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p8_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages behind p8_found: how widely each recurs and what it was taken for."""
    messages = classified_messages(candidate_messages(table(spark, sf_dir, "documents")))
    return messages.where("kind is not null").select("message", "kind", "n_documents", "n_sources")


QUERIES = {f.__name__: f for f in (p6_ids, p7_containers, p8_found, p8_messages)}
ORACLE: dict[str, str] = {}
