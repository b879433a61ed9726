"""Queries of the subpackage over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm import bpe, lookalike, mixing, mojibake, quality, survivors, truncation
from darkslide.session import cut
from darkslide.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entries").select(F.col("entry_id").alias("rec_id"), "entry_name", "rel_folder")
    return mojibake.find(e, {"entry_name": True, "rel_folder": False}).select(F.col("rec_id").alias("entry_id"), "field")


def p1_restored(spark: SparkSession, root: str) -> DataFrame:
    """The affected values with their restored text; what was lost stays marked."""
    e = table(spark, root, "entries").select(F.col("entry_id").alias("rec_id"), "entry_name", "rel_folder")
    return mojibake.find(e, {"entry_name": True, "rel_folder": False}).withColumnRenamed("rec_id", "entry_id")


def p2_forms(spark: SparkSession, root: str) -> DataFrame:
    """Values that are not in their consistent form, with that form."""
    e = table(spark, root, "entries").select(F.col("entry_id").alias("rec_id"), "rel_folder", "name")
    return lookalike.canonical(e, ["rel_folder", "name"]).withColumnRenamed("rec_id", "entry_id")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_forms(spark, root).select("entry_id", "field")


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """Entry names (of sidecars, what stands before `.json`) and sidecar titles; a title's sibling is the name of its sidecar."""
    e = table(spark, root, "entries")
    name = F.when(F.col("is_json"), F.regexp_replace("name", r"(?i)\.json$", "")).otherwise(F.col("name"))
    e = e.select(F.col("entry_id").alias("rec_id"), F.lit("name").alias("field"), F.col("origin").alias("source"), name.alias("text"), F.coalesce("is_json", F.lit(False)).alias("sidecar_name"), F.lit(None).cast("string").alias("sibling"))
    s = table(spark, root, "sidecars")
    sibling = F.regexp_replace(F.regexp_extract("entry_name", r"([^/]*)$", 1), r"(?i)\.json$", "")
    s = s.select(F.col("sidecar_id").alias("rec_id"), F.lit("title").alias("field"), F.col("origin").alias("source"), F.col("title").alias("text"), F.lit(False).alias("sidecar_name"), sibling.alias("sibling"))
    return e.unionByName(s)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.find(_texts(spark, root)).select("field", "rec_id")


def p3_cuts(spark: SparkSession, root: str) -> DataFrame:
    """The cut values with what tells them: the length's test, the chance of a limit there, the source's broken transfers, the posterior, and the sibling's word."""
    return truncation.find(_texts(spark, root)).withColumnRenamed("source", "origin")


def p3_shares(spark: SparkSession, root: str) -> DataFrame:
    """Share of cut values per field and origin."""
    texts = _texts(spark, root)
    return truncation.shares(texts, truncation.find(texts)).withColumnRenamed("source", "origin")


def _records(spark: SparkSession, root: str) -> DataFrame:
    return survivors.contents(table(spark, root, "journal"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    kept = survivors.survivors(_records(spark, root), ["path", "year", "name"], ["albums"], "written_at")
    return kept.select(F.col("content").alias("sha"), "rec_id")


def p6_survivors(spark: SparkSession, root: str) -> DataFrame:
    """One record per content: the surviving record's id, the best value of each field, all albums, and how many archive entries hold the content's size and checksum."""
    r = cut(_records(spark, root), "contents")
    kept = survivors.survivors(r, ["path", "year", "name"], ["albums"], "written_at")
    best = survivors.best_values(r, ["path", "year", "name"], "stage").groupBy("content").pivot("field", ["path", "year", "name"]).agg(F.first("value"))
    albums = survivors.all_items(r, "albums").withColumnRenamed("items", "albums")
    parts = F.split("id", ":")
    keys = r.where("content is not null and id is not null").groupBy("content").agg(F.max(F.struct(F.get(parts, F.lit(0)).try_cast("long").alias("size"), F.conv(F.get(parts, F.lit(1)), 16, 10).try_cast("long").alias("crc32"))).alias("k"))
    copies = table(spark, root, "entries").groupBy("size", "crc32").agg(F.count("*").alias("entries"))
    keys = keys.select("content", "k.size", "k.crc32").join(copies, ["size", "crc32"], "left").select("content", "crc32", F.coalesce("entries", F.lit(0)).alias("entries"))
    out = kept.join(best, "content", "left").join(albums, "content", "left").join(keys, "content", "left")
    return out.withColumnRenamed("content", "sha")


def _vocabulary() -> F.Column:
    return bpe.rank_map(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")
    return bpe.encode(docs, _vocabulary()).withColumnRenamed("id", "doc_id")


def _mixed(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    tokens = bpe.token_counts(docs.select(F.col("doc_id").alias("id"), "text"), _vocabulary())
    sized = cut(docs.select(F.col("doc_id").alias("id"), "source").join(tokens, "id"), "sizes")
    return mixing.mix(sized, table(spark, root, "mix_targets"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The order of the mix, a line for each occurrence of a document."""
    return _mixed(spark, root).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of all tokens by source."""
    return mixing.shares(_mixed(spark, root), table(spark, root, "mix_targets"))


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")


def p9_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Characters of each document by kind of text."""
    return quality.classify(_docs(spark, root), table(spark, root, "common_words")).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_kinds(spark, root).where("found").select("doc_id")


def p9_stats(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of each whole document; null texts have those of an empty text."""
    return quality.text_stats(_docs(spark, root), table(spark, root, "common_words")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_forms, p3_found, p3_cuts, p3_shares, p6_found, p6_survivors, p7_ids, p8_mix, p8_shares, p9_found, p9_kinds, p9_stats)}


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_P6 = f"""
    WITH j AS (SELECT *, regexp_replace(lower(trim(sha, {_BLANK})), '^sha-?256[:=]', '') AS h0 FROM journal),
    r AS (SELECT *, CASE WHEN regexp_matches(h0, '^[0-9a-f]{{8,64}}$') THEN h0 END AS h FROM j),
    f AS (SELECT DISTINCT h AS full_hash FROM r WHERE length(h) = 64),
    s AS (SELECT h, min(full_hash) AS one FROM (SELECT DISTINCT h FROM r WHERE length(h) < 64) JOIN f ON left(full_hash, 8) = left(h, 8) AND starts_with(full_hash, h) GROUP BY h HAVING count(*) = 1),
    i AS (SELECT id, min(x) AS one FROM (SELECT id, h AS x FROM r WHERE length(h) = 64 UNION SELECT id, one FROM r JOIN s USING (h)) WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT x) = 1),
    many AS (SELECT h, list(full_hash) AS fulls FROM (SELECT DISTINCT h FROM r WHERE length(h) < 64) JOIN f ON left(full_hash, 8) = left(h, 8) AND starts_with(full_hash, h) GROUP BY h HAVING count(*) > 1),
    c AS (SELECT r.*, CASE WHEN length(r.h) = 64 THEN r.h WHEN r.h IS NULL THEN i.one WHEN s.one IS NOT NULL THEN s.one WHEN list_contains(many.fulls, i.one) THEN i.one END AS content
          FROM r LEFT JOIN s ON s.h = r.h LEFT JOIN i ON i.id = r.id LEFT JOIN many ON many.h = r.h),
    k AS (SELECT content, rec_id, count(*) OVER (PARTITION BY content) AS n, row_number() OVER (PARTITION BY content ORDER BY
          CAST(coalesce(trim(path, {_BLANK}) <> '', false) AS INTEGER) + CAST(coalesce(trim(year, {_BLANK}) <> '', false) AS INTEGER) + CAST(coalesce(trim(name, {_BLANK}) <> '', false) AS INTEGER)
          + CAST(coalesce(len(list_filter(albums, lambda a: trim(a, {_BLANK}) <> '')) > 0, false) AS INTEGER) DESC, written_at DESC NULLS LAST, rec_id DESC) AS rn FROM c WHERE content IS NOT NULL)
    SELECT content AS sha, rec_id FROM k WHERE rn = 1 AND n >= 2"""


def oracle_sql() -> dict[str, str]:
    """SQL with the same rows, where SQL can say it; the other operators are tested against brute force, round trips and inspected cases."""
    return {"p6_found": _P6}
