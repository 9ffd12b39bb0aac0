"""The queries of this subpackage: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ids import bare_docid
from palimpsest.llm import cut_texts, leaks, main_content, mixing, near_duplicates, site_lines, term_counts, top_items
from palimpsest.sources.tables import table


#: A public byte-level BPE vocabulary; another is named by the environment.
TOKENIZER = os.environ.get("PALIMPSEST_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.similar_pages(table(spark, root, "document_snapshot"))


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.page_groups(table(spark, root, "document_snapshot"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return main_content.furniture_lines(table(spark, root, "document_snapshot"))


def p3_clean(spark: SparkSession, root: str) -> DataFrame:
    return main_content.main_content(table(spark, root, "document_snapshot"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return term_counts.snapshot_term_counts(table(spark, root, "document_snapshot"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, root, "document_snapshot")).select("sub_collection", "docid", "line_no")


def p5_sequences(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.line_sequences(table(spark, root, "document_snapshot"))


def p5_clean(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.without_repeated_lines(table(spark, root, "document_snapshot"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    run = table(spark, root, "run_result").select("name", F.trim("qid").alias("qid"), bare_docid(F.col("docno")).alias("docid"), "score")
    return top_items.top_items(run, ["name", "qid"], "docid", "score", 10).select("name", "qid", "docid", "pos")


def p7_matches(spark: SparkSession, root: str) -> DataFrame:
    return leaks.find_leaks(table(spark, root, "documents"), table(spark, root, "heldout_item"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_matches(spark, root).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return leaks.without_leaks(docs, p7_matches(spark, root)).select("doc_id", "source")


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_report(*mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_target"), TOKENIZER))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_target"), TOKENIZER)[1]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_report(spark, root).filter("short").select("source")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return cut_texts.cut_documents(table(spark, root, "documents")).filter("cut").select("doc_id")


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return cut_texts.cut_report(cut_texts.cut_documents(table(spark, root, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_groups,
        p3_found,
        p3_clean,
        p4_found,
        p5_found,
        p5_sequences,
        p5_clean,
        p6_found,
        p7_found,
        p7_matches,
        p7_clean,
        p8_found,
        p8_report,
        p8_mix,
        p9_found,
        p9_report,
    )
}
