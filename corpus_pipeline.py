"""A training-data pipeline over documents: toxicity, line dedup, near-duplicate removal, source mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes each result as Parquet in the shared folder and reads it
back as the next stage's docs. All stages but the last return the columns of documents, whatever other columns docs has; the last returns pieces.
All take null ids, texts, languages and sources, empty and very long texts, repeated rows and empty tables; what becomes of them stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightloom.llm.common import saved, table
from nightloom.llm.lines import dedup_lines
from nightloom.llm.mixing import mix_sources
from nightloom.llm.ngram_join import near_duplicates
from nightloom.llm.packing import pack
from nightloom.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels of these documents, doesn't reject. Null and empty texts, and those without letters, stay;
    repeated rows fare alike; rows with a null id are judged too. Without labels of both kinds all stay."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.where("predicted = 0").select(*COLUMNS)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, all of them; n_chars follows the text where lines went, and stays (null, too) where none did. Null text stays null; a
    null source is a site of its own; a text of boilerplate alone becomes empty; repeated rows lose the same lines."""
    return dedup_lines(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one whose id names it. A document without shingles (null, empty or blank text) is in a class of its own, as is each row with a
    null id. Of several rows with one id the one with the longest text stays, the smallest text of equally long ones."""
    extra = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = saved(several.join(extra, "doc_id", "left_anti").withColumn("gone", F.lit(False)).union(extra.withColumn("gone", F.lit(True))), "near-duplicates")
    alone = docs.join(several.select("doc_id").hint("merge"), "doc_id", "left_anti").select(*COLUMNS)
    first = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "text", "lang", "source", "n_chars")  # the rows of one id
    kept = docs.join(several.where("not gone").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS, F.row_number().over(first).alias("place"))
    return alone.union(kept.where("place = 1").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh alike, in shuffled order. A null source is one of them; null and empty texts count like others;
    repeated rows are repeated alike."""
    return mix_sources(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are their closing id;
    repeated rows and rows with a null id are packed each."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix),
    ("best_fit_packing", pack_sequences),
]

#: The network and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
