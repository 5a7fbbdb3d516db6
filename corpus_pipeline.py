"""From raw documents to token ids: toxic texts, near-duplicates and benchmark leaks go, personal data is replaced.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that the
next stage reads, with the columns of documents, but for the last, which returns token ids. Rows
without text are clean for every stage and end as rows without ids. doc_ids may be null or
repeated: decisions on rows then go by row_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.chunks import encode_chunked, word_vocabulary
from helixlake.llm.contamination import contaminated_keys
from helixlake.llm.minhash import near_duplicate_rows
from helixlake.llm.pii import free_name, replace_entities, session_key
from helixlake.llm.shared import row_key, saved, table
from helixlake.llm.toxicity import drop_toxic, learned


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that the classifier calls toxic."""
    return drop_toxic(docs, learned(spark, sf_dir, docs))


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't in the one column of gone."""
    name = free_name("_gone", docs.columns)
    return docs.join(saved(gone.toDF(name), "gone"), key == F.col(name), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id; of rows alike in doc_id and text, any one."""
    key, unique = row_key(docs)
    found = near_duplicate_rows(docs, key, unique)
    if unique:
        return without(docs, key, found.where("not kept").select("row_key"))
    found = saved(found, "found")
    again = saved(found.where("kept and n_shingles > 0").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"), "again")
    rest = without(docs, key, found.where("not kept").select("row_key").union(again))
    name = free_name("_row_key", docs.columns)
    return rest.union(docs.join(again.toDF(name), key == F.col(name)).dropDuplicates([name]).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that hold a window of a benchmark item."""
    key, _ = row_key(docs)
    found = contaminated_keys(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, key, found.where("contaminated").select("doc_id"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    out = replace_entities(docs, key=session_key(spark), count_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian) and digests of the ids and of the text they decode to."""
    both = encode_chunked(docs, word_vocabulary(), decode=True, memo=MEMO)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Pieces that the encoder of a worker remembers: workers outlive the stage, so this stays in memory beside other stages.
MEMO = 100_000

STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("pii", private), ("bpe", encode)]
#: A trained classifier and byte-pair merges have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
