"""One query per operator over its whole table, with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm import audit, html, katz, langid, lines, mixing, oracles, pii, retrieval, secrets, seeds, simhash, spots, tokens
from fogbank.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judged(table(spark, sf_dir, "documents")).drop("host")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents")).drop("source")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_language_id, op2_personal_data, op3_secret_scan, op4_token_counts, op5_simhash, op6_katz_scores, op7_html_text,
    op8_decontaminate, op9_line_quality, op10_mix_sources, op11_filter_audit, op12_ranked_search, op13_spot_fingerprints)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLES: dict[str, str] = {"op8_decontaminate": oracles.DECONTAMINATE, "op9_line_quality": oracles.LINE_QUALITY,
                           "op11_filter_audit": oracles.FILTER_AUDIT, "op12_ranked_search": oracles.RANKED_SEARCH, "op13_spot_fingerprints": oracles.FINGERPRINTS}
