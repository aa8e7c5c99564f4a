"""Cross-site line deduplication by distinct-site spread.

A HyperLogLog sketch of sites is kept for each line hash and merged by aggregation. Lines whose estimate lies clearly on one
side of the threshold are settled by it; those near it get an exact distinct count. Of each line found on enough sites the
first occurrence stays and all others go, so that no content is lost for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, write_table

#: log2 of a sketch's registers; its standard error is 1.04 / sqrt(4096) = 1.6 %.
LG_REGISTERS = 12


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line with anything but spaces: doc_id, text_key, site, pos and two independent 64-bit hashes (h1, h2) of the line."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return lines.filter(F.trim("line") != "").select("doc_id", "text_key", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = 5, band: float = 0.1) -> DataFrame:
    """Hashes of lines on at least ``min_sites`` distinct sites, with the document and position of the first occurrence.

    ``band``: estimates within this share of the threshold (six standard errors) count as near and are settled exactly.
    """
    lines = line_rows(docs)
    spread, path = write_table(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("sites"), F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first"))
        .filter(F.col("n") >= min_sites)
        .select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("estimate"))
        .filter(F.col("estimate") >= int(min_sites * (1 - band))),
        "line-spread",
    )
    sure = spread.filter(F.col("estimate") > min_sites * (1 + band))
    near = spread.filter(F.col("estimate") <= min_sites * (1 + band))
    exact = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count().filter(F.col("count") >= min_sites)
    found = sure.select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))
    out, _ = write_table(found, "boilerplate")
    delete_path(docs.sparkSession, path)
    return out


def drop_boilerplate(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with boilerplate lines cut from text, and n_lines and n_removed added."""
    lines = line_rows(docs).join(found, ["h1", "h2"])
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("pos") == F.col("first.pos"))
    cut = lines.filter(~here).groupBy(F.col("doc_id").alias("cut_doc"), F.col("text_key").alias("cut_key")).agg(F.collect_set("pos").alias("cut_lines"))
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(cut, docs["doc_id"].eqNullSafe(cut["cut_doc"]) & (F.xxhash64(text) == cut["cut_key"]), "left")
    parts, gone = F.split(text, "\n", -1), cut["cut_lines"]
    kept = F.when(gone.isNull(), docs["text"]).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    own = [kept.alias(c) if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*own, F.size(parts).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_removed"))


def dedup_lines(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """``docs`` without repeated cross-site lines.

    A site is the source column (null: one site of its own). Lines of spaces alone never count. Null text stays null and has
    one empty line. Rows equal in doc_id and text are the same document and keep the same lines. An empty table gives none.
    """
    return drop_boilerplate(docs, boilerplate(docs, min_sites))


ORACLE = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
b AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS f FROM l WHERE trim(line) <> ''
  GROUP BY line HAVING count(DISTINCT site) >= 5),
k AS (
  SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AND (l.doc_id <> b.f.d OR l.pos <> b.f.p) AS cut
  FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (cut) AS INTEGER) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '')) AS kept_md5
FROM k GROUP BY doc_id
"""
