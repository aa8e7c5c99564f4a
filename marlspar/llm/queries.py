"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_sf
from .lines import ORACLE as LINES_SQL

TOKENIZER = "byte_bpe_50k.json"


def tokenizer() -> str:
    """Path of the tokenizer that the queries take."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    kept = dedup_lines(read_sf(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_sf(spark, sf_dir, "documents"), tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_bins", "bound")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = read_sf(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_sf(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import remove_repeats

    return remove_repeats(read_sf(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_ids

    return token_ids(read_sf(spark, sf_dir, "documents"), tokenizer(), end_id=2)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .templates import leaks

    return leaks(read_sf(spark, sf_dir, "documents"), read_sf(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_sf(spark, sf_dir, "documents"))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transport import media_features, store_media

    return media_features(store_media(read_sf(spark, sf_dir, "documents"))[0])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = read_sf(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    return read_archives(write_archives(read_sf(spark, sf_dir, "pages"))[0])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_ids": op5_token_ids,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_transport_streams": op8_transport_streams,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op1_line_dedup": LINES_SQL}
