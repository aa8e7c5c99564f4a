"""From raw documents to packed training sequences: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspar.llm import langid, lines, near, packing, templates
from marlspar.llm.common import delete_path, read_sf, write_table
from marlspar.llm.queries import tokenizer

#: Texts whose best language has a smaller mean marginal are in none of the learned languages (a documented parameter).
LEAST_SCORE = 0.35


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null texts and those without a letter go. With nothing to learn from all stay."""
    model = langid.fit(docs)
    if model is None:
        return docs
    seen = langid.identify(docs, model, extra=tuple(docs.columns))
    return seen.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines repeated across sites; every document stays."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component (five-word shingles, similarity 0.8): that with the smallest doc_id, ids that are null last.

    Texts without words, null among them, are one component; of repeated rows one stays; an empty table stays empty.
    """
    return near.drop_near_duplicates(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, told by id and text, so that rows without an id go too where they leak.

    Null and empty texts hold none and stay; repeated rows share a decision; an empty benchmark leaves all.
    """
    found = templates.leak_pairs(docs, read_sf(spark, sf_dir, "benchmark")).select(F.col("doc_key").alias("leak_key")).distinct()
    return docs.join(found, templates.text_key() == found["leak_key"], "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences; null texts have their end id alone, repeated rows are documents of their own."""
    return packing.pack_documents(docs, tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", keep_languages), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]

#: The stages hold a trained model, hashes of tokens and a packing heuristic, none of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet in the shared folder and read again; the table before it goes."""
    docs, before = read_sf(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir), name)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
