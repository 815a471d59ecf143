"""From raw documents to packed training sequences, in five stages; each works on all that the one before kept.

All stages but the last return the columns of documents. A document is a key with its text: a row whose key is null, or stands on
several texts, is judged by a key made of what it holds, so that one text's verdict never takes another's row, and is given
back under its own. Equal rows are copies of a document. Keys are integers below 2^62. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read_table, with_maybe, without
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.packing import pack
from tidemark.llm.quality_model import quality_scores
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.suffix_dedup import remove_repeats


#: Stages run one after another in the same workers; batches of this size leave room beside what each stage keeps.
BATCH_BYTES = 4 << 20
MADE = 1 << 62  # made keys begin here, above all others, so that a row with a key of its own represents a group


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a key for each text in doc_id and their own in __own."""
    text = F.xxhash64("text", F.length("text"), "lang")
    made = lambda *what: F.lit(MADE) + F.shiftrightunsigned(F.xxhash64(*what), 2)
    known = docs.withColumn("__own", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("__text", text)
    several = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("__text").alias("a"), F.max("__text").alias("b")).where("a <> b").select("doc_id")
    marked = with_maybe(known, "doc_id", scratch.table(several, "several"))
    found = marked.where("maybe").join(several.select(F.col("doc_id").alias("key"), F.lit(True).alias("many")), "key", "left").select("row.*", F.coalesce("many", F.lit(False)).alias("many"))
    rows = marked.where("not maybe").select("row.*", F.lit(False).alias("many")).unionByName(found)
    key = F.when(F.col("doc_id").isNull(), made("__text")).when(F.col("many"), made("doc_id", "__text")).otherwise(F.col("doc_id"))
    return rows.withColumn("doc_id", key).drop("many", "__text")


def _as_given(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.withColumn("doc_id", F.col("__own")).select(*docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    scratch = Scratch(spark, "pipe-classify", BATCH_BYTES)
    keyed = _keyed(docs, scratch)
    scores = quality_scores(keyed, read_table(spark, sf_dir, "labels"), scratch)
    return _as_given(without(keyed, "doc_id", scratch.table(scores.where("predicted = 0").select("doc_id"), "gone")), docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts or their language's perplexity bands go."""
    scratch = Scratch(spark, "pipe-rules", BATCH_BYTES)
    keyed = _keyed(docs, scratch)
    judged = quality_rules(keyed, scratch)
    return _as_given(without(keyed, "doc_id", scratch.table(judged.where("not kept").select("doc_id"), "gone")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near duplicates the document with the smallest key stays, one row of it; made keys come after all others.
    Texts without words and without a key of their own are linked with nothing and stay."""
    scratch = Scratch(spark, "pipe-near", BATCH_BYTES)
    keyed = _keyed(docs, scratch)
    groups = scratch.table(jaccard_components(keyed, scratch).select("doc_id", "n_shingles", "component_id"), "groups")
    told_apart = groups.where((F.col("doc_id") < MADE) | (F.col("n_shingles") > 0))
    repeated = told_apart.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    return _as_given(without(keyed, "doc_id", groups.where("doc_id <> component_id").select("doc_id"), repeated), docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that stand earlier go; n_chars follows. Rows with a made key come after all others; equal rows without
    a key are one document, of which every row is cut alike."""
    scratch = Scratch(spark, "pipe-repeats", BATCH_BYTES)
    out = _as_given(remove_repeats(_keyed(docs, scratch), scratch), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its place in a sequence of at most 2048 tokens."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), Scratch(spark, "pipe-pack", BATCH_BYTES))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeats), ("best_fit_packing", packing)]

#: Fitted models and tokenizers are not for SQL to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
