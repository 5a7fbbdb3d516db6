"""Hand-made cases, brute force and invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.operators import chains as C
from helixlake.operators import intervals as V
from helixlake.operators import motifs as M
from helixlake.operators import samplers as G
from helixlake.operators import sequences as S
from helixlake.operators import trees as Y
from helixlake.operators import walks as K
from helixlake.sources import text as T


def seqs(spark, *nts):
    return spark.createDataFrame([(i, f"> s{i}", nt) for i, nt in enumerate(nts)], "seq_id long, name string, nt string")


def test_runs_and_masks(spark):
    q = seqs(spark, "AAAACCXXGGGGG")
    assert S.mask_runs(q, 4).first().nt == "XXXXCCXXXXXXX"
    assert S.mask_runs(q, 4, mask_trailing=False).first().nt == "XXXXCCXXGGGGG"
    assert sorted(tuple(r) for r in S.find_runs(q, 4).select("base", "start", "run_len", "is_trailing").collect()) == [("A", 0, 4, False), ("G", 8, 5, True)]


def test_reverse_complement_and_palindromes(spark):
    q = seqs(spark, "ACGX", "ACGCGT", "AACGTC", "GACGTT")
    assert [r[0] for r in q.select(N.revcomp("nt")).collect()] == ["XCGT", "ACGCGT", "GACGTT", "AACGTC"]
    rows = {r.kmer: (r.fwd, r.rev) for r in S.kmer_canonical(q).collect()}
    assert rows["ACGCGT"] == (1, 0) and rows["AACGTC"] == (1, 1) and rows["ACGX"] == (1, 0)


def test_interval_rules(spark):
    def merged(rule, *spans):
        rows = [("g%d" % i, 1, s, e, s, "+") for i, (s, e) in enumerate(spans)]
        genes = spark.createDataFrame(rows, "gene string, chrom long, g_start long, g_end long, tss long, strand string")
        return sorted((r.g_start, r.g_end) for r in V.merge_overlaps(genes, rule).collect())

    assert merged("max", (0, 100), (10, 20), (50, 120)) == [(0, 120)] and merged("last", (0, 100), (10, 20), (50, 120)) == [(0, 20), (50, 120)]
    assert merged("max", (0, 100), (10, 20), (50, 60)) == [(0, 100)] and merged("last", (0, 100), (10, 20), (50, 60)) == [(0, 20), (50, 60)]
    assert merged("max", (0, 10), (10, 20)) == [(0, 10), (10, 20)]


def test_ks_distance(spark):
    rows = [(1, 0, 0, 0, p, v) for p, v in enumerate([0, 0, 1, 2]) if v] + [(1, 10, 0, 0, p, v) for p, v in enumerate([0, 1, 1, 5]) if v]
    samples = spark.createDataFrame(rows, "walk_id long, step long, seq_id long, motif int, pos long, n long")
    r = K.ks(samples, 4).first()
    assert r.d == pytest.approx(0.25) and 0 < r.p <= 1


def test_quorum(spark):
    rows = [(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (2, 1, "A"), (2, 2, "B"), (3, 1, ""), (3, 2, "")]
    out = K.quorum(spark.createDataFrame(rows, "wu_id long, result_id long, payload string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1, True), (1, 1, 2, True), (1, 1, 3, False)]


def test_tree_columns(spark):
    pi = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}
    cols = spark.createDataFrame([(0, "x", "A"), (0, "y", "A"), (1, "x", "A"), (1, "y", "C")], "col long, leaf string, base string")
    for length, want in ((0.0, {0: 0.3, 1: 0.0}), (60.0, {0: 0.09, 1: 0.06})):
        tree = [("r", None, 0.0, None), ("a", "r", length, "x"), ("b", "r", length, "y")]
        got = {r.col: r.likelihood for r in Y.tree_column(cols, tree, pi).collect()}
        assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("nt", ["ACGTACGT", "ACGXACGT", "ACG", "AC"])
def test_placements_by_enumeration(spark, nt):
    got = {r.k: r.n for r in G.count_placements(seqs(spark, nt), (3,), 2).collect()}
    starts = [i for i in range(len(nt) - 2) if "X" not in nt[i : i + 3]]
    assert got == {0: 1, 1: len(starts), 2: sum(b - a >= 3 for a, b in itertools.combinations(starts, 2))}


def test_sampled_sites_follow_the_weights():
    r = [np.where(np.arange(14) >= 2, np.arange(14) + 1.0, 0)]
    cfg = G.Config(widths=(3,), max_sites=2)
    draws = [tuple(G.draw_sites(r, (3,), cfg, G.rng_of(1, i))) for i in range(4000)]
    assert all(b[1] - a[1] >= 3 for d in draws for a, b in zip(d, d[1:])) and {len(d) for d in draws} == {0, 1, 2}
    single = G.Config(widths=(3,), max_sites=1, blocks=(0.0, 1.0))
    one = [G.draw_sites(r, (3,), single, G.rng_of(2, i))[0][1] for i in range(8000)]
    assert np.abs(np.bincount(one, minlength=14) / 8000 - r[0] / r[0].sum()).max() < 0.02


def test_chains_resume_and_repeat(spark):
    rng = np.random.default_rng(3)
    planted = ["".join(rng.choice(list("ACGT"), 40)) + "CACGTGCC" + "".join(rng.choice(list("ACGT"), 40)) for _ in range(25)] + ["ACXXXXGT", "A"]
    q = seqs(spark, *planted)
    bg = S.background(q)
    walks = spark.range(2).withColumnRenamed("id", "walk_id")
    cfg = G.Config(widths=(8,), max_sites=1, burn_in=16, samples=4, blocks=(0.02, 0.98))
    whole = sorted(map(tuple, C.gibbs_walks(q, walks, bg, cfg).collect()))
    again = sorted(map(tuple, C.gibbs_walks(q.repartition(5), walks.repartition(2), bg, cfg).collect()))
    half = C.gibbs_walks(q, walks, bg, cfg, until=13)
    assert whole == again == sorted(map(tuple, C.gibbs_walks(q, walks, bg, cfg, half, done=13).collect()))
    samples = [r for r in whole if r[1] == "sample"]
    assert all(r[5] <= cfg.samples for r in samples)
    final = {(r[0], r[2]): r[4] for r in whole if r[1] == "final"}
    assert max(sum(abs(final.get((w, i), -99) - 47) <= 3 for i in range(25)) for w in range(2)) > 12
    assert not any(i == 25 for _, i in final)
    samples, sites, pwm = C.gibbs_blocked(q, bg, G.Config(widths=(8,), max_sites=1, burn_in=3, samples=2))
    assert sites.count() and all("X" not in planted[r.seq_id][r.s_start : r.s_end] and r.s_end - r.s_start == 8 for r in sites.collect())
    assert samples.agg(F.max("n")).first()[0] <= 2 and all(abs(r.s - 1) < 1e-9 for r in pwm.groupBy("motif", "col").agg(F.sum("p").alias("s")).collect())


def test_locations_and_groups(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 0), (3, 9_000_000), (4, 5)], "chrom long, size long")
    points = [0, 9, 10, 11, 4_194_303, 4_194_304, 9_000_009, 9_000_010, 9_000_014, 9_000_015, -1]
    got = sorted(tuple(r) for r in V.locate(spark.createDataFrame([(x,) for x in points], "point long"), sizes).collect())
    assert got == [(0, 1, 0), (9, 1, 9), (10, 3, 0), (11, 3, 1), (4_194_303, 3, 4_194_293), (4_194_304, 3, 4_194_294), (9_000_009, 3, 8_999_999), (9_000_010, 4, 0), (9_000_014, 4, 4)]
    q = spark.createDataFrame([(x,) for x in (0, 5, 9, 200_000, 400_000)], "seq_id long")
    starts = spark.createDataFrame([(5,), (8,), (300_000,)], "start long")
    assert sorted(tuple(r) for r in V.groups_of(q, starts).collect()) == [(0, None), (5, 5), (9, 8), (200_000, 8), (400_000, 300_000)]


def test_masks_keep_other_letters(spark):
    q = seqs(spark, "AANNAAAACC", "NNNNNAAAA")
    assert [r.nt for r in S.mask_runs(q, 4).orderBy("seq_id").collect()] == ["AANNXXXXCC", "NNNNNXXXX"]
    assert [r.nt for r in S.mask_runs(q, 4, mask_trailing=False).orderBy("seq_id").collect()] == ["AANNXXXXCC", "NNNNNAAAA"]
    assert sorted(tuple(r) for r in S.find_runs(q, 4).select("seq_id", "base", "start", "run_len").collect()) == [(0, "A", 4, 4), (1, "A", 5, 4)]


@pytest.mark.parametrize("w", [6, 9])
def test_scan_by_brute_force(spark, w):
    """Windows of short and long sequences, with tables of one and of two blocks of columns."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGTX"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in (0, 3, w, 70, 500)]
    q = seqs(spark, *texts)
    p = {m: rng.dirichlet(np.ones(4), w) for m in (2, 5)}
    pwm = spark.createDataFrame([(m, c, b, float(p[m][c, i])) for m in p for c in range(w) for i, b in enumerate("ACGT")], "motif int, col int, base string, p double")
    bg = spark.createDataFrame([(b, 0.25) for b in "ACGT"], "base string, p double")
    want = {}
    for k, t in enumerate(texts):
        for i in range(1 if w == 1 else 0, len(t) - w + 1):
            if "X" not in t[i : i + w]:
                r = {m: np.prod([p[m][c, "ACGT".index(t[i + c])] / 0.25 for c in range(w)]) for m in p}
                for m in p:
                    want[k, i + w - 1, m] = (len(t) - i - w, r[m], sum(r.values()))
    got = {(r.seq_id, r.end, r.motif): (r.dist_from_end, r.ratio, r.all_ratios) for r in M.pwm_scan(q, pwm, bg, w).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_models(spark, sf_dir):
    from helixlake.sources import inputs as I

    q = I.seqs(spark, sf_dir)
    counts = M.motif_counts(I.sites(q))
    for pwm in (M.normalised(counts), M.pwm_palindromic(counts), M.em_refine(q, M.normalised(counts), S.background(q), 6, least=6, most=8)[0]):
        assert all(abs(r.s - 1) < 1e-9 for r in pwm.groupBy("motif", "col").agg(F.sum("p").alias("s")).collect())
    got = M.fitness(q, M.normalised(counts).withColumnRenamed("motif", "candidate_id"), 6, compat=True)
    assert got.where("fitness <= 0").count() == 0


@pytest.mark.parametrize("compat", [False, True])
def test_fitness_by_brute_force(spark, compat):
    """Sets of models over all windows; the compatible form compares a window with the reversed one that begins one base further."""
    rng, w = np.random.default_rng(8), 4
    texts = ["".join(rng.choice(list("ACGTX"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in (0, 3, 4, 5, 90)]
    p = {(c, m): rng.dirichlet(np.ones(4), w) for c, m in ((0, 0), (0, 1), (1, 0))}
    rows = [(c, m, i, b, float(p[c, m][i, k])) for c, m in p for i in range(w) for k, b in enumerate("ACGT")]

    def product(model, site):
        return 0.0 if "X" in site else float(np.prod([model[i, "ACGT".index(b)] for i, b in enumerate(site)]))

    want = {0: 0.0, 1: 0.0}
    for t in texts:
        for i in range(len(t) - w + (not compat)):
            site = t[i : i + w]
            if not compat and "X" in site:
                continue
            other = t[i + 1 : i + 1 + w][::-1] if compat else site[::-1].translate(str.maketrans("ACGT", "TGCA"))
            for c in want:
                left = 1.0
                for m in sorted(m for k, m in p if k == c):
                    b = max(product(p[c, m], site), product(p[c, m], other))
                    want[c] += left * b * float(np.prod(p[c, m].max(axis=0)))
                    left *= 1 - b
    df = spark.createDataFrame(rows, "candidate_id int, model int, col int, base string, p double")
    got = {r.candidate_id: r.fitness for r in M.fitness(seqs(spark, *texts), df, w, compat).collect()}
    assert got == pytest.approx(want)


def test_em_stops_and_rises(spark, sf_dir):
    from helixlake.sources import inputs as I

    q = I.seqs(spark, sf_dir).where("seq_id < 40")
    pwm, trace = M.em_refine(q, M.normalised(M.motif_counts(I.sites(q))), S.background(q), 6, tol=1e9, least=7)
    lls = [r.ll for r in trace.orderBy("step").collect()]
    assert len(lls) == 7 and lls[-1] > lls[0]


def test_best_places_apart(spark):
    rows = [(1, 0, 0, 1.0), (1, 1, 0, 0.6), (1, 2, 0, 2.0), (1, 5, 1, 1.5), (1, 20, 0, 1.0), (1, 23, 0, 1.0), (1, 40, 0, 9.0)]
    out = M.apart(spark.createDataFrame(rows, "seq_id long, s_start long, motif int, gain double"), spark.createDataFrame([(1, 42)], "seq_id long, s_start long"), 6)
    assert sorted((r.s_start, r.motif) for r in out.collect()) == [(2, 0), (20, 0)]


def test_random_windows(spark):
    sizes = spark.createDataFrame([(1, 30), (2, 25), (3, 4)], "chrom long, size long")
    nt = {1: "ACGTACGTACGTACGTACGTACGTACGTAC", 2: "ACGTAXGTACGTACGTACGTACGTA", 3: "ACGT"}
    chunks = spark.createDataFrame([(c, i, t[i : i + 10]) for c, t in nt.items() for i in range(0, len(t), 10)], "chrom long, chunk_start long, nt string")
    out = V.random_windows(sizes, chunks, 40, 6, 1, 10).collect()
    assert 20 < len(out) <= 40 and all(r.nt == nt[r.chrom][r.start : r.end] and len(r.nt) == 6 and "X" not in r.nt for r in out)


def test_centroid(spark):
    draws = spark.createDataFrame([(1, 10, 6), (1, 11, 3), (1, 30, 2), (1, 50, 9)], "seq_id long, end long, n long")
    assert [(r.s_start, r.s_end, r.p) for r in G.centroid_sites(draws, 10, 6).collect()] == [(5, 11, 0.9), (45, 51, 0.9)]


def test_text_round_trips(spark, tmp_path):
    q = seqs(spark, "ACGTX", "GGGA", "TTTTTTTT")
    T.write_fasta(q.coalesce(1), f"{tmp_path}/fa")
    assert [(r.name, r.nt) for r in T.read_fasta(spark, f"{tmp_path}/fa").orderBy("seq_id").collect()] == [(r.name, r.nt) for r in q.collect()]
    (tmp_path / "raw.fa").write_text("> a b\r\nacg\r\ntt\n\n> c\nGG\nGA")
    assert [(r.name, r.nt) for r in T.read_fasta(spark, f"{tmp_path}/raw.fa").orderBy("seq_id").collect()] == [("> a b", "ACGTT"), ("> c", "GGGA")]
    (tmp_path / "sites").write_text("0,2:1,7.\n.\n1,4\n")
    assert [tuple(r) for r in T.read_sites(spark, f"{tmp_path}/sites", 3).orderBy("seq_id", "slot").collect()] == [(0, 0, 0, 0, 3), (0, 1, 1, 5, 8), (2, 0, 1, 2, 5)]
    (tmp_path / "walk_7_steps_400").write_text("0,0,3\n1,0\n")
    got = T.read_walk_files(spark, f"{tmp_path}/walk_*").collect()
    assert {(r.walk_id, r.from_step, r.step) for r in got} == {(7, None, 400)} and len(got) == 2
    assert [tuple(r) for r in T.read_samples(spark, f"{tmp_path}/walk_7_steps_400", 2).orderBy("motif").collect()] == [(0, 0, 2, 3), (0, 1, 0, 1)]
    (tmp_path / "pwm.csv").write_text("# a\n1,1,1,1\n\n2,0,0,2\n")
    assert {(r.col, r.base): r.p for r in T.read_pwm_csv(spark, f"{tmp_path}/pwm.csv").collect()}[1, "T"] == 0.5
    (tmp_path / "models").write_text(">reverse_complement\n1,0\n0,1\n0,0\n0,0\n>normal\n1 1\n0 0\n0 0\n1 1\n")
    rows = {(r.model, r.direction, r.col, r.base): r.p for r in T.read_motif_models(spark, f"{tmp_path}/models").collect()}
    assert rows[0, "reverse", 0, "G"] == 1.0 and rows[0, "reverse", 1, "T"] == 1.0 and rows[1, "forward", 0, "A"] == 0.5 and (1, "reverse", 0, "A") not in rows
    (tmp_path / "list").write_text("F heading\n\n3, 1 10 acgta CACGTG ttttt 15 0.5 > g chr1 1 2 3 +\nnonsense\n")
    good, bad = T.read_site_listing(spark, f"{tmp_path}/list")
    assert good.first().site == "CACGTG" and good.first().left == "acgta" and bad.count() == 1
    (tmp_path / "stats").write_text("words\n0 1.6 4.0 3.0 15.6 2.4 100\n")
    assert tuple(T.read_conv_stats(spark, f"{tmp_path}/stats").first())[:2] == (0, 1.6)
    (tmp_path / "genes").write_text("id\tsym\tchrom\ts\te\tstrand\n1\tabc:5\tchr1\t20\t10\t+\n2\tx:7\tchr1\t1\t9\t-\n")
    assert [(r.gene, r.g_start, r.g_end, r.tss) for r in T.read_genes(spark, f"{tmp_path}/genes", 1).collect()] == [("x", 1, 9, 7)]
    (tmp_path / "prior").write_text(">BLOCKS\n0 1\n1 3\n")
    assert [r.p for r in T.read_table(spark, f"{tmp_path}/prior", "k int, p double", ("p", [])).orderBy("k").collect()] == [0.25, 0.75]
    T.write_motif_stats(q, f"{tmp_path}/tsv")
    assert spark.read.csv(f"{tmp_path}/tsv", sep="\t", header=True).count() == 3


def test_streams_end_as_batches(spark, tmp_path, sf_dir):
    from helixlake.sources import inputs as I
    from helixlake.streaming import streams

    # with a processing-time timeout a drained query would go on with empty batches
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    results = I.results(spark, sf_dir).dropDuplicates(["wu_id", "result_id"])
    for k in range(2):
        results.where(F.col("result_id") % 2 == k).coalesce(1).write.parquet(f"{tmp_path}/results/part{k}")
    source = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/results/*")
    q = streams.quorum_stream(source).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.wu_id for r in spark.table("decided").where("state = 'canonical'").collect()}
    assert got == {r.wu_id for r in K.quorum(results).select("wu_id").distinct().collect()}

    samples = I.samples(spark, sf_dir)
    samples.repartition(3).write.parquet(f"{tmp_path}/samples")
    source = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/samples")
    q = streams.sample_stream(source).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("sums").collect())) == sorted(map(tuple, K.sum_walk(samples, 0).select("walk_id", "seq_id", "motif", "pos", "n").collect()))

    walks = spark.createDataFrame([(1, 1, 0, False), (2, 1, 10, False), (3, 1, 0, False)], "walk_id long, sampler_id long, current_steps long, had_error boolean")
    streams.create_walk_table(walks, f"{tmp_path}/walks")
    units = spark.createDataFrame([(1, 0, 10, False), (1, 0, 10, False), (2, 0, 10, False), (3, 0, 10, True)], "walk_id long, from_steps long, steps long, failed boolean")
    units.coalesce(1).write.parquet(f"{tmp_path}/units")
    source = spark.readStream.schema(units.schema).parquet(f"{tmp_path}/units")
    streams.walk_state_stream(source, f"{tmp_path}/walks", f"{tmp_path}/c3").awaitTermination(90)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/walks").drop("bucket").collect())) == [(1, 1, 10, False), (2, 1, 10, False), (3, 1, 0, True)]

    samples.repartition(4, "walk_id", "step").write.parquet(f"{tmp_path}/snapshots")
    source = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/snapshots")
    streams.ks_stream(source, f"{tmp_path}/arrived", f"{tmp_path}/tests", I.CELLS, f"{tmp_path}/c4").awaitTermination(90)
    got = {(r.walk_id, r.step): (r.d, r.p) for r in streams.latest_tests(spark.read.parquet(f"{tmp_path}/tests")).collect()}
    want = {(r.walk_id, r.step): (r.d, r.p) for r in K.ks(samples, I.CELLS).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
