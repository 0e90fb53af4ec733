"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import (
    ann, chat_format, decontaminate, language_id, license_scan, line_quality, lm_score, mixing, ngram_join, spelling, token_pack, turn_repair, url_filter)
from scoreloom.llm.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(load(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_summary(license_scan.scan_licences(load(spark, sf_dir, "documents")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_conversations(turns))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return line_quality.score(docs, line_quality.train(docs, load(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(load(spark, sf_dir, "documents")).selectExpr("doc_id", "size", "source_size", "target", "size * times AS taken")


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.written_and_read(load(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return turn_repair.repair_summary(turn_repair.repair_conversations(turn_repair.damaged(turns)), turns)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(load(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


QUERIES["op1_decontamination"] = op1_decontamination
ORACLES["op1_decontamination"] = decontaminate.ORACLE
QUERIES["op2_token_blocks"] = op2_token_blocks
QUERIES["op4_mixing"] = op4_mixing
ORACLES["op4_mixing"] = mixing.ORACLE
QUERIES["op5_ngram_jaccard_join"] = op5_ngram_jaccard_join
ORACLES["op5_ngram_jaccard_join"] = ngram_join.ORACLE
QUERIES["op10_quality_classifier"] = op10_quality_classifier
QUERIES["op7_license_scan"] = op7_license_scan
QUERIES["op8_chat_format"] = op8_chat_format
ORACLES["op8_chat_format"] = chat_format.ORACLE
QUERIES["op9_url_filter"] = op9_url_filter
ORACLES["op9_url_filter"] = url_filter.ORACLE
QUERIES["op6_ann"] = op6_ann
QUERIES["op3_lm_scoring"] = op3_lm_scoring
QUERIES["op11_conversation_repair"] = op11_conversation_repair
ORACLES["op11_conversation_repair"] = turn_repair.ORACLE
QUERIES["op12_spelling_variants"] = op12_spelling_variants
ORACLES["op12_spelling_variants"] = spelling.ORACLE
QUERIES["op13_language_id"] = op13_language_id
