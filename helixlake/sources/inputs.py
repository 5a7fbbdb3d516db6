"""Motif tables as deterministic projections of the given tables, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.functions.nt import revcomp

#: Letters map to bases in a cycle; q, x and z are masked.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CODED = "ACGTACGTACGTACGTXCGTACGXAXACGTACGTACGTACGTXCGTACGXAX"
#: Windows of a piece that a sequence is cut into.
CHUNK = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where(F.length("text") > 0)
    nt = F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), LETTERS, CODED)
    return docs.select(F.col("doc_id").alias("seq_id"), F.concat(F.lit("> doc"), F.col("doc_id").cast("string")).alias("name"), nt.alias("nt"))


#: Walks of a sampler, sequences that its walks share, motifs and positions of a sequence.
SAMPLER_WALKS, SAMPLER_SEQS, MOTIFS, POSITIONS = 5, 4, 3, 50
#: Cells of a walk's domain.
CELLS = SAMPLER_SEQS * MOTIFS * POSITIONS


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sampler_id, walk_id, iter, seq_id, motif, pos, k): a drawn site for each event.

    A user is a walk and five of them a sampler with sequences of its own, so walks, samplers and sequences grow with the table.
    """
    e = read(spark, sf_dir, "events")
    sampler = F.floor(F.col("user_id") / SAMPLER_WALKS).cast("long")
    return e.select(
        sampler.alias("sampler_id"), F.col("user_id").cast("long").alias("walk_id"), F.dayofmonth("ts").cast("long").alias("iter"), (sampler * SAMPLER_SEQS + F.col("event_id") % SAMPLER_SEQS).cast("long").alias("seq_id"),
        F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2).cast("int").alias("motif"), (F.floor("value") % POSITIONS).cast("long").alias("pos"), (1 + F.col("event_id") % 7).cast("long").alias("k"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulated counts (sampler_id, walk_id, step, seq_id, motif, pos, n) with a snapshot of each walk every three iterations."""
    step = (10000 * F.floor((F.col("iter") - 1) / 3)).cast("long")
    return draws(spark, sf_dir).groupBy("sampler_id", "walk_id", step.alias("step"), "seq_id", "motif", "pos").agg(F.sum("k").alias("n"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 400 + F.col("l_linenumber") * 37
    return line.select(
        F.concat(F.lit("g"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("gene"), F.col("l_suppkey").cast("long").alias("chrom"), start.cast("long").alias("g_start"),
        (start + 40 + F.col("l_quantity").cast("long")).cast("long").alias("g_end"), (start + 20).cast("long").alias("tss"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
    )


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("walk_id"), F.col("c_nationkey").cast("long").alias("sampler_id"), (10000 * (F.col("c_custkey") % 50)).cast("long").alias("current_steps"), (F.col("c_acctbal") < 0).alias("had_error"))


def samplers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("sampler_id"), F.col("n_name").alias("name"), F.lit(100000).cast("long").alias("burn_in"), (100000 * (F.col("n_regionkey"))).cast("long").alias("samples"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    payload = F.when(F.col("l_quantity") < 2, "").otherwise(F.concat("l_returnflag", "l_linestatus"))
    return line.select(F.col("l_orderkey").cast("long").alias("wu_id"), F.col("l_linenumber").cast("long").alias("result_id"), payload.alias("payload"))


def chunked(seqs: DataFrame, w: int, size: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """seq_id, keep, len, at, part: pieces of size + w - 1 bases, one each size bases, so that no window of w is cut.

    One regular expression cuts a sequence in one pass, so a long one costs no more for each base than a short one.
    """
    pieces = F.regexp_extract_all("nt", F.lit(f"(?s)(?=(.{{1,{size + w - 1}}})).{{1,{size}}}"), F.lit(1))
    # the outer form has no filters that would compute the pieces again
    own = ["seq_id", *(keep or [])]
    return seqs.select(*own, F.length("nt").alias("len"), F.posexplode_outer(pieces).alias("k", "part")).select(*own, "len", (F.col("k") * size).cast("long").alias("at"), "part")


def windows(seqs: DataFrame, w: int, short: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(seq_id, keep, len, pos, site): every window of w bases, pos 0-based; with short, a sequence of fewer bases is one window."""
    own = ["seq_id", *(keep or []), "len"]
    part = chunked(seqs, w, keep=keep)
    full = F.when(F.length("part") >= w, F.sequence(F.lit(0), F.least(F.length("part") - w, F.lit(CHUNK - 1))))
    if short:
        full = full.when((F.col("at") == 0) & (F.length("part") > 0), F.array(F.lit(0)))
    return part.select(*own, "at", "part", F.explode(full).alias("i")).select(*own, (F.col("at") + F.col("i")).alias("pos"), F.substring(F.col("part"), F.col("i") + 1, F.lit(w)).alias("site"))


def bases(seqs: DataFrame) -> DataFrame:
    """(seq_id, pos, base), a row for each position."""
    return seqs.select("seq_id", F.posexplode(F.split("nt", "")).alias("pos", "base")).where("base != ''").withColumn("pos", F.col("pos").cast("long"))


def sites(seqs: DataFrame) -> DataFrame:
    """Non-overlapping matches of CANNTG (seq_id, s_start, s_end, motif, strand, site), half-open.

    One pass cuts a sequence behind each match; only the matches move, to add up their lengths. Two matches can only overlap
    by four bases, and the second of such a pair can't overlap a third, so leftmost matches are those wanted.
    """
    upto = F.regexp_extract_all("nt", F.lit(r"(?s)\G.*?CA[ACGT]{2}TG"), F.lit(0))
    each = seqs.select("seq_id", F.posexplode_outer(upto).alias("k", "m")).where("m is not null").select("seq_id", "k", F.length("m").alias("n"), F.right("m", F.lit(6)).alias("site"))
    end = F.sum("n").over(Window.partitionBy("seq_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    third = F.substring("site", 3, 1)
    return each.withColumn("s_end", end).select(
        "seq_id", (F.col("s_end") - 6).alias("s_start"), "s_end", F.when(third.isin("A", "C"), 0).when(third == "G", 1).otherwise(2).alias("motif"),
        F.when(F.col("site") <= revcomp("site"), "F").otherwise("R").alias("strand"), "site",
    )
