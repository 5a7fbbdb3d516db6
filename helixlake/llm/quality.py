"""Quality rules with adaptive thresholds (operator 8).

Per text: counts of words, symbols, repeated lines and repeated 8-word windows. Per language
and source: a quantile sketch of each rate. The sketch is a histogram over logarithmic
buckets (relative error ``ERROR``): two sketches merge by adding counts, so Spark builds
it with one partial aggregation and no group is gathered anywhere. The upper fence of a
group, high quantile + SPREAD * (high quantile - median), replaces a fixed cut-off. Sketches are of
the texts that pass the base rule, so that texts which fail anyway don't widen the fences.
Groups with fewer than MIN_GROUP such texts use the merged sketch of their language. Where
nearly all texts of a group have a zero rate its fence is zero; a guard keeps it from dropping
each text with one symbol or one repeated line.

Edge cases: null and empty texts have zero counts and fail the base rule (under 20 words);
null language or source is a group of its own; repeated rows are judged row by row; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.shared import id_text, saved, table

#: Width of a bucket: values in it differ by this share at most.
ERROR = 0.02
#: Offset that makes the logarithm of a zero rate finite; rates under it are one bucket.
LEAST = 1e-4
SPREAD, LOW_Q, MIDDLE_Q, HIGH_Q, MIN_GROUP = 4.0, 0.1, 0.5, 0.85, 50
#: No fence falls below these guards.
FLOORS = {"symbol_rate": 0.02, "dup_line_rate": 0.15, "repeat_rate": 0.08, "upper_rate": 0.02}
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
UPPER[ord("A") : ord("Z") + 1] = True
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"


def per_text(mask_sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask_sums) + 1, dtype=np.int64)
    np.cumsum(mask_sums, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (doc, key) occurs twice or more, and whether it isn't the first; input order is text order."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    later, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, later


def count_slice(t: K.Texts) -> dict[str, np.ndarray]:
    data, bounds = t.data, t.bounds
    w = t.words(K.SPACE, K.EXACT)
    in_word = ~K.SPACE[data]
    code_point = (data & 0xC0) != 0x80
    out = {"n_words": w.counts, "word_chars": per_text(in_word & code_point, bounds), "n_symbols": per_text(SYMBOLS[data], bounds)}
    newline = np.zeros(256, dtype=bool)
    newline[10] = True
    start, end = K.word_spans(data, bounds, newline)
    words_before = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = words_before[1] > words_before[0]
    start, end = start[full], end[full]
    line_doc = np.searchsorted(bounds, start, side="right") - 1
    line_doc = np.minimum(line_doc, t.n - 1)
    _, later = repeated(K.spans_hash(data, start, end, K.EXACT), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=t.n)
    out["n_lines"] = np.bincount(line_doc, minlength=t.n)
    at, h = w.grams(8)
    again, _ = repeated(h, w.doc[at]) if len(at) else (np.zeros(0, bool), None)
    steps = np.zeros(len(w.h) + 9, dtype=np.int32)
    np.add.at(steps, at[again], 1)
    np.add.at(steps, at[again] + 8, -1)
    hit = np.cumsum(steps)[: len(w.h)] > 0
    out["n_repeat_words"] = np.bincount(w.doc[hit], minlength=t.n)
    out["n_upper"], out["n_letters"] = per_text(UPPER[data], bounds), per_text(LETTER[data], bounds)
    return out


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""

    def run(batches):
        for t in K.slices(batches):
            c = count_slice(t)
            names = [x.split()[0] for x in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([t.ids(), t.ids("lang"), t.ids("source"), *(pa.array(c[n].astype(np.int64)) for n in names)], ["doc_id", "lang", "source", *names])

    return id_text(docs, "doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(run, f"doc_id long, lang string, source string, {COUNTS}")


def rates() -> dict:
    least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / least_one("word_chars"),
        "dup_line_rate": F.col("n_dup_lines") / least_one("n_lines"),
        "repeat_rate": F.col("n_repeat_words") / least_one("n_words"),
        "upper_rate": F.col("n_upper") / least_one("n_letters"),
    }


def sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketch of every rate."""
    step = float(np.log1p(ERROR))
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), F.ceil(F.log(F.greatest(v, F.lit(LEAST))) / step).cast("int").alias("bucket")) for k, v in rates().items()))
    return counts.select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Low, middle and high quantile of each merged sketch, within ERROR; rates under LEAST are zero."""
    step = float(np.log1p(ERROR))
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    zero = int(np.ceil(np.log(LEAST) / step))
    value = F.when(F.col("bucket") <= zero, F.lit(0.0)).otherwise(F.exp(F.col("bucket") * F.lit(step)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), value))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(LOW_Q).alias("low"), at(MIDDLE_Q).alias("mid"), at(HIGH_Q).alias("high"))


def fences(sketches: DataFrame) -> DataFrame:
    """(lang, source, <rate>_fence...): a row per group."""
    fence = F.col("high") + F.lit(SPREAD) * (F.col("high") - F.col("mid"))
    own = quantiles(sketches, ["lang", "source"]).select("lang", "source", "metric", "total", fence.alias("own"))
    wide = quantiles(sketches, ["lang"]).select(F.col("lang").alias("l2"), F.col("metric").alias("m2"), fence.alias("wide"))
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("metric") == F.col("m2")))
    used = F.when(F.col("total") >= MIN_GROUP, F.col("own")).otherwise(F.col("wide"))
    return both.groupBy("lang", "source").agg(*(F.greatest(F.lit(v), F.max(F.when(F.col("metric") == k, used))).alias(f"{k}_fence") for k, v in FLOORS.items()))


def quality(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and the adaptive verdict of every row of docs(doc_id, text, lang, source)."""
    counts = saved(text_counts(docs), "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    limits = fences(sketch(counts.where(~failed))).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    ok = ~F.col("base_failed")
    for k, v in rates().items():
        ok = ok & (v <= F.coalesce(F.col(f"{k}_fence"), F.lit(FLOORS[k])))
    joined = counts.join(limits, counts.lang.eqNullSafe(limits.g_lang) & counts.source.eqNullSafe(limits.g_source), "left").withColumn("base_failed", failed)
    return joined.withColumn("kept", ok).drop("g_lang", "g_source")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
