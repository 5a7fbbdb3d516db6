"""Readers and writers of the text formats; all are splittable or line-oriented Spark sources.

Positions in tables are 0-based and half-open; readers and writers convert.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.sources.inputs import CHUNK
from helixlake.sources.store import stored


def _numbered(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(line, value): records with their place among all files, in the order of file names.

    Records are numbered within each split of a file as they are read, and each split begins where those before it
    end; only one row for each split is put in order.
    """
    rows = spark.read.text(path, **options).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    splits = rows.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy().orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    begin = splits.select("f", "b", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(begin, ["f", "b"]).select((F.col("i") + F.col("shift")).alias("line"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark, path)


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """A text file whose lines are the values of rows(value, order...) in the order: ranges of rows are files whose names ascend, so that _numbered restores the place of each line."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seqs: a record begins at each '>'; blank lines and carriage returns don't matter."""
    rows = _numbered(spark, path, lineSep="\n>").withColumnRenamed("line", "seq_id")
    name = F.trim(F.regexp_replace(N.strip_cr(F.substring_index("value", "\n", 1)), "^>", ""))
    body = F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1)
    return rows.select("seq_id", F.concat(F.lit("> "), name).alias("name"), F.upper(F.regexp_replace(body, r"\s+", "")).alias("nt")).where(F.length("nt") > 0)


def read_chromosomes(spark: SparkSession, path: str, size: int = 10_000) -> DataFrame:
    """(chrom, chunk_start, nt) of a file with chromosomes, by lines, so that none is ever one string.

    A line belongs to the last header before it; its bases begin after those of the lines before. Lines are cut at the bounds of
    the chunks and put together there.
    """
    lines = _lines(spark, path).select("line", F.trim(N.strip_cr("value")).alias("value"))
    head = F.col("value").startswith(">")
    width = 1 << 16
    blocked = lines.withColumn("block", F.floor(F.col("line") / width)).withColumn("head", F.when(head, F.struct("line", F.trim(F.substring("value", 2, 1 << 20)).alias("chrom"))))
    sums = blocked.groupBy("block").agg(F.max("head").alias("last"), F.sum(F.when(~head, F.length("value")).otherwise(0)).alias("n"))
    before = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("block", F.last("last", ignorenulls=True).over(before).alias("carried"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("block").orderBy("line")
    n = F.when(head, 0).otherwise(F.length("value"))
    placed = blocked.withColumn("own", F.last("head", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.sum(n).over(within.rowsBetween(Window.unboundedPreceding, 0)) - n).join(carried, "block")
    placed = placed.select("value", F.coalesce("own", "carried").alias("h"), (F.col("at") + F.col("offset")).alias("at"), head.alias("is_head"))
    starts = placed.where("is_head").select(F.col("h.line").alias("hl"), F.col("at").alias("origin"))
    bases = placed.where("not is_head and value != '' and h is not null").join(starts, F.col("h.line") == F.col("hl")).select("h.chrom", (F.col("at") - F.col("origin")).alias("pos"), F.upper("value").alias("value"))
    cut = bases.withColumn("chunk_start", F.explode(F.sequence(F.floor(F.col("pos") / size) * size, F.floor((F.col("pos") + F.length("value") - 1) / size) * size, F.lit(size))))
    lo = F.greatest(F.col("chunk_start") - F.col("pos"), F.lit(0))
    part = F.substring("value", (lo + 1).cast("int"), (F.least(F.col("pos") + F.length("value"), F.col("chunk_start") + size) - F.col("pos") - lo).cast("int"))
    met = cut.select("chrom", "chunk_start", "pos", part.alias("part")).groupBy("chrom", "chunk_start").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return met.select("chrom", "chunk_start", F.array_join("p.part", "").alias("nt"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size) of an index: the first two of tab-separated columns."""
    part = F.split("value", "\t")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(part[0].alias("chrom"), part[1].cast("long").alias("size"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    seqs.select(F.concat_ws("\n", F.concat(F.lit("> "), F.trim(F.regexp_replace("name", "^>", ""))), "nt", F.lit("")).alias("value")).write.text(path)


def site_lines(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """(seq_id, value): 'motif,end:motif,end.' for each sequence; end is inclusive."""
    each = sites.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("s_start", F.concat_ws(",", F.col("motif").cast("string"), (F.col("s_end") - 1).cast("string")).alias("t")))).alias("r"))
    return seqs.select("seq_id").join(each, "seq_id", "left").select("seq_id", F.concat(F.coalesce(F.array_join("r.t", ":"), F.lit("")), F.lit(".")).alias("value"))


def parse_site_lines(lines: DataFrame, width: int) -> DataFrame:
    """sites(seq_id, slot, motif, s_start, s_end) from (seq_id, value)."""
    each = lines.select("seq_id", F.posexplode(F.split(F.rtrim(F.regexp_replace("value", r"\.\s*$", "")), ":")).alias("slot", "t")).where("t != ''")
    part = F.split("t", ",")
    end = part[1].cast("long") + 1
    return each.where(end > 0).select("seq_id", "slot", part[0].cast("int").alias("motif"), (end - width).alias("s_start"), end.alias("s_end"))


def write_sites(sites: DataFrame, seqs: DataFrame, path: str) -> None:
    """A file whose line i has the sites of the i-th sequence by seq_id."""
    write_lines(site_lines(sites, seqs), path, "seq_id")


def read_sites(spark: SparkSession, path: str, width: int) -> DataFrame:
    """sites of a file in which line i is sequence i."""
    return parse_site_lines(_lines(spark, path).withColumnRenamed("line", "seq_id"), width)


def bad_sites(sites: DataFrame, seqs: DataFrame, n_motifs: int) -> DataFrame:
    """(seq_id, slot, reason) of sites(seq_id, slot, motif, s_start, s_end) that can't be: no such sequence or motif, out of range, masked, or overlapping the site before."""
    before = F.max("s_end").over(Window.partitionBy("seq_id").orderBy("s_start", "slot").rowsBetween(Window.unboundedPreceding, -1))
    met = sites.withColumn("before", before).join(seqs.select("seq_id", "nt"), "seq_id", "left")
    part = F.substring("nt", (F.col("s_start") + 1).cast("int"), (F.col("s_end") - F.col("s_start")).cast("int"))
    reason = F.when(F.col("nt").isNull(), "sequence").when(~F.col("motif").between(0, n_motifs - 1), "motif").when((F.col("s_start") < 0) | (F.col("s_end") > F.length("nt")), "range").when(part.contains("X"), "masked").when(F.col("before") > F.col("s_start"), "overlap")
    return met.select("seq_id", "slot", reason.alias("reason")).where("reason is not null")


def sample_lines(samples: DataFrame, seqs: DataFrame, n_motifs: int) -> DataFrame:
    """(line, value): a line of comma-joined counts for each sequence and motif, zeros included."""
    cells = samples.groupBy("seq_id", "motif").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("long"), "n"))).alias("m"))
    frame = seqs.select("seq_id", F.length("nt").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(n_motifs - 1))).alias("motif"))
    value = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("len").cast("long") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("string")), ",")
    return frame.join(cells, ["seq_id", "motif"], "left").select((F.col("seq_id") * n_motifs + F.col("motif")).alias("line"), value.alias("value"))


def parse_sample_lines(lines: DataFrame, n_motifs: int) -> DataFrame:
    """Stored counts (seq_id, motif, pos, n) of (line, value); zeros aren't kept."""
    each = lines.select("line", F.posexplode(F.split("value", ",")).alias("pos", "v"))
    return each.select(F.floor(F.col("line") / n_motifs).cast("long").alias("seq_id"), (F.col("line") % n_motifs).cast("int").alias("motif"), F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("n")).where("n > 0")


def bad_sample_lines(lines: DataFrame, seqs: DataFrame, n_motifs: int) -> DataFrame:
    """Lines whose number of values isn't the length of their sequence."""
    found = lines.select(F.floor(F.col("line") / n_motifs).cast("long").alias("seq_id"), "line", F.size(F.split("value", ",")).alias("k"))
    return found.join(seqs.select("seq_id", F.length("nt").alias("len")), "seq_id", "left").where("len is null or k != len")


def write_samples(samples: DataFrame, seqs: DataFrame, n_motifs: int, path: str) -> None:
    """A file with n_motifs lines for each sequence, those of the i-th sequence by seq_id from line i * n_motifs on."""
    write_lines(sample_lines(samples, seqs, n_motifs), path, "line")


def read_samples(spark: SparkSession, path: str, n_motifs: int) -> DataFrame:
    return parse_sample_lines(_lines(spark, path), n_motifs)


def read_walk_files(spark: SparkSession, glob: str) -> DataFrame:
    """(value, walk_id, from_step, step): lines of files, or of folders of files, named walk_<id>_steps_<n>, walk_<id>_steps_range_<a>_<b>, samples_<id>_<n> or motifs_<id>_<n>; from_step is null but for ranges."""
    name = F.col("_metadata.file_path")
    pattern = r"[/=](?:walk_(\d+)_steps_(?:range_(\d+)_)?|(?:samples|motifs)_(\d+)_)(\d+)[^/]*(?:/[^/]*)?$"
    got = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return spark.read.text(glob).select("value", F.coalesce(got(1), got(3)).cast("long").alias("walk_id"), got(2).cast("long").alias("from_step"), got(4).cast("long").alias("step")).where("step is not null")


def read_pwm_csv(spark: SparkSession, path: str) -> DataFrame:
    """(col, base, p): four weights a line, '#' and blank lines skipped, rows made to add up to one."""
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    col = (F.row_number().over(Window.partitionBy().orderBy("line")) - 1).alias("col")  # a model has a few lines
    each = rows.select(col, "value").select("col", F.posexplode(F.split("value", ",")).alias("k", "v")).select("col", F.element_at(F.array(*map(F.lit, N.BASES)), F.col("k") + 1).alias("base"), F.trim("v").cast("double").alias("v"))
    return each.select("col", "base", (F.col("v") / F.sum("v").over(Window.partitionBy("col"))).alias("p"))


def read_motif_models(spark: SparkSession, path: str) -> DataFrame:
    """(model, type, direction, col, base, p): '>type' and four lines of weights in the order A, C, G, T; reverse-complement types give a second, mirrored model."""
    rows = _numbered(spark, path, lineSep="\n>").withColumnRenamed("line", "model")
    kind = F.lower(F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")))
    each = rows.select("model", kind.alias("type"), F.posexplode(F.slice(F.split("value", "\n"), 2, 4)).alias("k", "line"))
    cells = each.select("model", "type", F.element_at(F.array(*map(F.lit, N.BASES)), F.col("k") + 1).alias("base"), F.posexplode(F.split(F.trim("line"), r"[,\s]+")).alias("col", "v"))
    pwm = cells.select("model", "type", F.lit("forward").alias("direction"), "col", "base", (F.col("v").cast("double") / F.sum(F.col("v").cast("double")).over(Window.partitionBy("model", "col"))).alias("p"))
    last = F.max("col").over(Window.partitionBy("model"))
    mirror = pwm.where(F.col("type") == "reverse_complement").select("model", "type", F.lit("reverse").alias("direction"), (last - F.col("col")).alias("col"), F.translate("base", "ACGT", "TGCA").alias("base"), "p")
    return pwm.unionByName(mirror)


def pwm_count_lines(counts: DataFrame) -> DataFrame:
    """(motif, value): a header and one line of counts for each base."""
    w = Window.partitionBy("motif")
    width = counts.select("motif", (F.max("col").over(w) + 1).alias("w")).distinct()
    grid = width.withColumn("base", F.explode(F.array(*map(F.lit, N.BASES)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    full = grid.join(counts, ["motif", "col", "base"], "left")
    line = full.groupBy("motif", "w", "base").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("n", F.lit(0)).cast("string").alias("n")))), lambda s: s["n"]), " ").alias("l"))
    body = line.groupBy("motif", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "l"))), lambda s: s["l"]), "\n").alias("b"))
    return body.select("motif", F.concat(F.lit(">motif"), F.col("motif").cast("string"), F.lit(" NORMAL "), F.col("w").cast("string"), F.lit("\n"), "b").alias("value"))


def write_pwm_counts(counts: DataFrame, path: str) -> None:
    """Records of counts(step, motif, col, base, n), in a folder for each step and direction; motifs of even number are forward."""
    steps = [r.step for r in counts.select("step").distinct().orderBy("step").collect()]  # a dump has a few steps
    out = None
    for step in steps:
        lines = pwm_count_lines(counts.where(F.col("step") == step).drop("step")).withColumn("step", F.lit(step))
        out = lines if out is None else out.union(lines)
    if out is not None:
        direction = F.when(F.col("motif") % 2 == 0, "forward").otherwise("reverse")
        out.select("value", "step", direction.alias("direction")).write.partitionBy("step", "direction").text(path)


#: Small keyed tables of a prior file by kind: columns, and what is made to add up to one for which keys.
LAYOUTS: dict[str, tuple[str, tuple[str, list[str]] | None]] = {
    "transitions": ("prev string, cur string, p double", ("p", ["prev"])),
    "ends": ("place string, motif int, p double", ("p", ["place"])),
    "positions": ("ord int, motif int, p double", ("p", ["ord"])),
    "sites": ("motif int, n double", None),
    "mask": ("col int, used int", None),
    "background": ("base string, p double", ("p", [])),
    "initial": ("seq_id long, motif int, s_start long", None),
}


def read_layout(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the LAYOUTS."""
    schema, normalise = LAYOUTS[kind]
    return read_table(spark, path, schema, normalise)


#: The fields of a printed site, in their order: name, type, form and what stands behind it.
FIELDS = (
    ("seq_id", "long", r"\d+", r",\s*"), ("motif", "int", r"\d+", r"\s+"), ("start", "long", r"\d+", r"\s+"), ("left", "string", "[a-z ]*", r"\s*"), ("site", "string", "[A-Z]+", r"\s*"),
    ("right", "string", "[a-z ]*", r"\s+"), ("end", "long", r"\d+", r"\s+"), ("frac", "double", "[0-9.]+", r"\s+"), ("header", "string", ">.*", ""),
)
LISTING = r"^\s*" + "".join(f"({form}){behind}" for _, _, form, behind in FIELDS) + "$"


def read_site_listing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(site rows, rejected lines) of a printed listing; headings that begin with F or R, and blank lines, are neither."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^([FR]|\s*$)"))
    rows = lines.where(F.col("value").rlike(LISTING)).select(*(F.trim(F.regexp_extract("value", LISTING, i + 1)).cast(t).alias(n) for i, (n, t, _, _) in enumerate(FIELDS)))
    return rows, lines.where(~F.col("value").rlike(LISTING))


def listing_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.col("seq_id").cast("string"), F.lit(", "), F.col("motif").cast("string"), F.lit(" "), F.col("start").cast("string"), F.lit(" "), "left", F.lit(" "), "site", F.lit(" "), "right", F.lit(" "), F.col("end").cast("string"), F.lit(" "), F.col("frac").cast("string"), F.lit(" "), "header").alias("value"))


def write_motif_stats(stats: DataFrame, path: str, fmt: str = "tsv") -> None:
    """As tab-separated lines with a header, JSON lines, or table rows joined by '& '."""
    if fmt == "tsv":
        stats.write.csv(path, sep="\t", header=True)
    elif fmt == "json":
        stats.write.json(path)
    else:
        stats.select(F.concat_ws("& ", *(F.col(c).cast("string") for c in stats.columns)).alias("value")).write.text(path)


def read_genes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """genes of tab-separated id, symbol:tss, chrom, start, end, strand with a header; exactly limit rows of the order in the file's table."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="id string, symbol string, chrom string, s long, e long, strand string")
    part = F.split("symbol", ":")
    out = rows.select(part[0].alias("gene"), "chrom", F.least("s", "e").alias("g_start"), F.greatest("s", "e").alias("g_end"), part[1].cast("long").alias("tss"), "strand")
    return out if limit is None else out.orderBy("chrom", "g_start", "gene").limit(limit)


def read_conv_stats(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Lines of seven numbers; others are skipped. Folders named column=value give further columns.

    key: a column of what stands before a tab in each line, so that many samplers share a file.
    """
    names = {"depth": "long", "min": "double", "avg": "double", "median": "double", "max": "double", "stddev": "double", "n": "long"}
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path)
    if key:
        rows = rows.where(F.instr("value", "\t") > 0).withColumn(key, F.substring_index("value", "\t", 1)).withColumn("value", F.expr("substring(value, instr(value, '\t') + 1)"))
    folders = [c for c in rows.columns if c != "value"]
    return rows.where(F.col("value").rlike(r"^\s*\d+(\s+[-0-9.e+]+){6}\s*$")).select(*folders, *(p[i].cast(t).alias(n) for i, (n, t) in enumerate(names.items())))


def read_conservation(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(name, at, values): probabilities by position, as arrays of size positions each; at is the first one's place.

    A record is a header line with '>' and lines of white-space separated numbers, as many as there are positions. Each split of a
    file is read on its own and once; only the arrays that it begins or ends within move, to be put together with those of the splits around it.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    found = stored(rows.mapInArrow(lambda batches: conservation_arrays(batches, size), PIECES), "arrays")
    # one row a split: what stands at its beginning goes on with the last record before
    ends = found.where(F.col("kind") == END).select("f", "b", "name", F.col("at").alias("n"))
    w = Window.partitionBy().orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = ends.withColumn("upto", F.coalesce(F.sum("n").over(w), F.lit(0)))
    since = F.last(F.when(F.col("name").isNotNull(), F.col("upto")), ignorenulls=True).over(w)
    carried = upto.select("f", "b", F.last("name", ignorenulls=True).over(w).alias("name"), (F.col("upto") - since).alias("begin")).where("name is not null")
    later = found.where(F.col("kind") == LATER).drop("name").join(F.broadcast(carried), ["f", "b"]).select("name", (F.col("at") + F.col("begin")).alias("first"), F.col("values").alias("v"))
    cut = later.unionByName(found.where(F.col("kind") == CUT).select("name", F.col("at").alias("first"), F.col("values").alias("v")))
    return found.where(F.col("kind") == WHOLE).select("name", "at", "values").unionByName(arrays_of(cut, ["name"], size))


#: Kinds of rows of conservation_arrays: an array of a record; the last one of a split, which may go on in the next; one before the first header of a split, whose place
#: counts from the split's beginning; and the end of a split, with the name of its last header and the number of values since.
WHOLE, CUT, LATER, END = range(4)
PIECES = "f string, b long, kind int, name string, at long, values array<double>"


def conservation_arrays(batches, size: int):
    """Rows of PIECES from lines (value, f, b), those of a split one after another: numbers as arrays of size, by their records."""
    rows: tuple[list, ...] = ([], [], [], [], [], [])  # as PIECES, but the lengths of the arrays
    parts: list[np.ndarray] = []
    split, name, at, rest = None, None, 0, np.zeros(0)

    def put(n: int, kind: int, where, lengths) -> None:
        own = split if kind != WHOLE else (None, None)
        for column, v in zip(rows, (*([x] * n for x in (*own, kind, name)), where, lengths)):
            column.extend(v)

    def take(v: np.ndarray) -> None:
        nonlocal at, rest
        v = np.concatenate([rest, v]) if len(rest) else v
        n = len(v) // size
        if n:
            put(n, LATER if name is None else WHOLE, range(at, at + n * size, size), [size] * n)
            parts.append(v[: n * size])
        at, rest = at + n * size, v[n * size :]

    def close(last: bool) -> None:
        nonlocal at, rest
        if len(rest):
            put(1, LATER if name is None else CUT if last else WHOLE, [at], [len(rest)])
            parts.append(rest)
        if last and split is not None:
            put(1, END, [at + len(rest)], [0])
        at, rest = 0, np.zeros(0)

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())
        values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rows[5])), pa.int32()), pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64()))
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds)), values], [c.split()[0] for c in PIECES.split(", ")])
        parts.clear()
        for c in rows:
            c.clear()
        return batch

    for batch in batches:
        if not batch.num_rows:
            continue
        lines = pc.ascii_trim_whitespace(pc.replace_substring(batch.column(0), "\r", ""))
        f, b = batch.column(1), batch.column(2)
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.or_(pc.not_equal(f[1:], f[:-1]), pc.not_equal(b[1:], b[:-1])).to_numpy(zero_copy_only=False)
        new[0] = split != (f[0].as_py(), b[0].as_py())
        head = pc.starts_with(lines, ">").to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(head), "", lines))
        # an empty line has one word without letters
        empty = pc.equal(pc.if_else(pa.array(head), "", lines), "").to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(np.where(empty, 0, pc.list_value_length(words).to_numpy(zero_copy_only=False))))
        values = pc.cast(words.filter(pa.array(~empty)).flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        marks = np.flatnonzero(new | head)
        for i, j in zip([0, *marks.tolist()], [*marks.tolist(), len(head)]):
            # lines i to j belong to one record and split, which line i may begin
            if i == j:
                continue
            if new[i]:
                close(last=True)
                split, name = (f[i].as_py(), b[i].as_py()), None
            if head[i]:
                close(last=False)
                name = "> " + lines[i].as_py()[1 : 1 + (1 << 20)].strip(" ")
            take(values[upto[i] : upto[j]])
        yield out()
    close(last=True)
    yield out()


def arrays_of(lines: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, at, values): arrays of size places from pieces (keys, first, v) of arrays, which follow one another without gaps."""
    last = F.col("first") + F.size("v") - 1
    cut = lines.where(F.size("v") > 0).withColumn("at", F.explode(F.sequence(F.floor(F.col("first") / size) * size, F.floor(last / size) * size, F.lit(size))))
    lo, hi = F.greatest("first", "at"), F.least(last + 1, F.col("at") + size)
    piece = cut.select(*keys, "at", lo.alias("lo"), F.slice("v", (lo - F.col("first") + 1).cast("int"), (hi - lo).cast("int")).alias("v"))
    return piece.groupBy(*keys, "at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "v"))), lambda x: x["v"])).alias("values"))


def read_position_background(spark: SparkSession, path: str, slack: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """((seq_id, pos, p), rejected (seq_id, pos, p)): lines of sequence and position, 1-based, around four probabilities in the order of the bases; lines that don't add up to one are rejected."""
    v = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select((v[0].cast("long") - 1).alias("seq_id"), (v[6].cast("long") - 1).alias("pos"), F.transform(F.slice(v, 3, 4), lambda x: x.cast("double")).alias("p"))
    good = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) <= slack
    return rows.where(good), rows.where(~F.coalesce(good, F.lit(False)))


#: Positions of a block of read_position_blocks.
BLOCK = 4096


def read_position_blocks(spark: SparkSession, path: str, w: int, slack: float = 0.001, size: int = BLOCK) -> DataFrame:
    """(seq_id, at, pieces: array of (i, p)): the good rows of read_position_background in blocks, for windows of w bases.

    A block at place at has size + w - 1 positions, as the pieces of chunked. i are 32-bit places in the block, p four 64-bit numbers for each.
    """

    def run(batches):
        for batch in batches:
            text = pc.ascii_trim_whitespace(pc.replace_substring(batch.column(0), ",", " "))
            words = pc.ascii_split_whitespace(text.filter(pc.invert(pc.or_(pc.equal(text, ""), pc.starts_with(text, "#")))))
            if not len(words):
                continue
            begin = words.offsets.to_numpy()[:-1]
            if pc.min(pc.list_value_length(words)).as_py() < 7:
                raise ValueError("a line of less than seven columns")
            of = lambda k, kind: words.values.take(pa.array(begin + k)).cast(kind).to_numpy()  # noqa: B023, E731
            seq, pos, p = of(0, pa.int64()) - 1, of(6, pa.int64()) - 1, np.stack([of(k, pa.float64()) for k in range(2, 6)], axis=1)
            good = (np.abs(p[:, 0] + p[:, 1] + p[:, 2] + p[:, 3] - 1) <= slack) & (pos >= 0)
            seq, pos, p = seq[good], pos[good], p[good]
            at = pos // size * size
            # the first positions of a block also stand at the end of the one before
            ahead = np.flatnonzero((pos - at < w - 1) & (at > 0))
            for s, a, x, v in ((seq, at, pos, p), (seq[ahead], at[ahead] - size, pos[ahead], p[ahead])):
                if len(s):
                    heads = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (a[1:] != a[:-1])))
                    spans = [*zip(heads.tolist(), [*heads[1:].tolist(), len(s)])]
                    i = (x - a).astype("<i4")
                    yield pa.RecordBatch.from_arrays([pa.array(s[heads]), pa.array(a[heads]), pa.array([i[b:e].tobytes() for b, e in spans]), pa.array([v[b:e].tobytes() for b, e in spans])], ["seq_id", "at", "i", "p"])

    pieces = spark.read.text(path).mapInArrow(run, "seq_id long, at long, i binary, p binary")
    return pieces.groupBy("seq_id", "at").agg(F.collect_list(F.struct("i", "p")).alias("pieces"))


def read_table(spark: SparkSession, path: str, schema: str, normalise: tuple[str, list[str]] | None = None) -> DataFrame:
    """A small prior table of white-space separated columns; normalise=(column, keys) makes the column add up to one for equal keys."""
    p = F.split(F.trim("value"), r"[\s,]+")
    fields = [f.strip().split(" ") for f in schema.split(",")]
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#>]|$)")).select(*(p[i].cast(t).alias(n) for i, (n, t) in enumerate(fields)))
    if normalise:
        c, keys = normalise
        rows = rows.withColumn(c, F.col(c) / F.sum(c).over(Window.partitionBy(*keys)))
    return rows


def prior_lines(counts: DataFrame) -> DataFrame:
    """(motif, value): a fitted model as a prior, percent / 10 as pseudo-counts, then its raw counts; a row for each column and base that occurs."""
    total = F.sum("n").over(Window.partitionBy("motif", "col"))
    each = counts.select("motif", "col", "base", F.round(10.0 * F.col("n") / total, 4).alias("pc"), "n")
    rows = F.array_sort(F.collect_list(F.struct("col", "base", "pc", "n")))
    line = lambda last: lambda x: F.concat_ws(" ", x["col"].cast("string"), x["base"], last(x))
    one = each.groupBy("motif").agg(rows.alias("r")).select("motif", F.array_join(F.transform("r", line(lambda x: F.format_number(x["pc"], 4))), "\n").alias("a"), F.array_join(F.transform("r", line(lambda x: x["n"].cast("string"))), "\n").alias("b"))
    return one.select("motif", F.concat(F.lit(">PSEUDO\n"), "a", F.lit("\n>COUNTS\n"), "b").alias("value"))


def flanked_sites(sites: DataFrame, seqs: DataFrame, k: int = 5) -> DataFrame:
    """(seq_id, s_start, value): each site with k bases on both sides, read on its strand."""
    met = sites.join(seqs.select("seq_id", "nt"), "seq_id")
    lo = F.greatest(F.col("s_start") - k, F.lit(0)).cast("int")
    text = F.substring(F.col("nt"), lo + 1, (F.col("s_end") + k).cast("int") - lo)
    return met.select("seq_id", "s_start", F.when(F.col("strand") == "R", N.revcomp(text)).otherwise(text).alias("value"))
