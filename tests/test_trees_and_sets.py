"""Trees, centroids, keyed permutations and stretches against brute force."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import samplers as G
from helixlake.operators import sequences as S
from helixlake.operators import trees as Y

TREE = [("r", None, 0.0, None), ("x", "r", 0.15, None), ("a", "x", 0.1, "a"), ("b", "x", 0.4, "b"), ("c", "r", 0.7, "c"), ("d", "r", 0.05, "d")]


def brute_likelihood(bases, tree, pi):
    """The sum over all bases of the inner nodes, branch by branch."""
    k = 1 / (1 - sum(v * v for v in pi.values()))
    inner = [n for n, _, _, leaf in tree if not leaf]
    total = 0.0
    unknown = [leaf for _, _, _, leaf in tree if leaf and bases.get(leaf) not in pi]
    for values in itertools.product("ACGT", repeat=len(inner) + len(unknown)):
        at = dict(zip(inner + unknown, values))
        p = 1.0
        for node, parent, t, leaf in tree:
            own = at[node] if not leaf else bases[leaf] if leaf not in unknown else at[leaf]
            e = math.exp(-k * t)
            p *= pi[own] if parent is None else (e if own == at[parent] else 0) + (1 - e) * pi[own]
        total += p
    return total


def test_tree_columns_by_enumeration(spark):
    rng, pi = np.random.default_rng(1), {"A": 0.4, "C": 0.1, "G": 0.2, "T": 0.3}
    columns = {col: {leaf: str(rng.choice(list("ACGTX"))) for leaf in "abcd" if rng.random() > 0.15} for col in range(40)}
    columns = {c: v for c, v in columns.items() if v}
    df = spark.createDataFrame([(c, leaf, b) for c, v in columns.items() for leaf, b in v.items()], "col long, leaf string, base string")
    got = {r.col: r.likelihood for r in Y.tree_column(df, spark.createDataFrame(TREE, Y.EDGES), pi).collect()}
    assert got == pytest.approx({c: brute_likelihood(v, TREE, pi) for c, v in columns.items()})


def test_tree_ratio_by_enumeration(spark):
    rng, bg = np.random.default_rng(2), {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}
    columns = {(a, col): {leaf: str(rng.choice(list("ACGT"))) for leaf in "abcd"} for a in range(2) for col in range(9) if (a, col) != (1, 4)}
    pwm = {(m, i): dict(zip("ACGT", rng.dirichlet(np.ones(4)))) for m, w in ((0, 3), (5, 2)) for i in range(w)}
    df = spark.createDataFrame([(a, c, leaf, b) for (a, c), v in columns.items() for leaf, b in v.items()], "aln long, col long, leaf string, base string")
    model = spark.createDataFrame([(m, i, b, float(p)) for (m, i), v in pwm.items() for b, p in v.items()], "motif int, col int, base string, p double")
    usual = spark.createDataFrame(list(bg.items()), "base string, p double")
    got = {(r.aln, r.start, r.motif): r.ln_ratio for r in Y.tree_ratio(df, TREE, model, usual).collect()}
    want = {}
    for a, start, (m, w) in itertools.product(range(2), range(9), ((0, 3), (5, 2))):
        if all((a, start + i) in columns for i in range(w)):
            want[a, start, m] = sum(math.log(brute_likelihood(columns[a, start + i], TREE, pwm[m, i]) / brute_likelihood(columns[a, start + i], TREE, bg)) for i in range(w))
    assert got == pytest.approx(want)


def test_bad_trees():
    with pytest.raises(ValueError):
        Y.edge_rows([("a", "b", 0.1, None), ("b", "a", 0.1, None)])
    with pytest.raises(ValueError):
        Y.edge_rows([("a", None, 0.0, "x"), ("b", None, 0.0, "y")])


@pytest.mark.parametrize("widths", [(4,), (4, 5), (3, 7)])
def test_centroid_is_the_best_of_all_subsets(spark, widths):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        draws = Counter()
        for _ in range(10):
            draws[int(rng.integers(len(widths))), int(rng.integers(6, 24))] += int(rng.integers(1, 5))
        n = 14
        places = sorted(draws)

        def value(m, end):
            near = 0
            for (m2, e2), k in draws.items():
                shared = min(end, e2) - max(end - widths[m], e2 - widths[m2])
                near += k * (shared >= max(widths[m], widths[m2]) // 2 + 1)
            return 2 * near - n, draws[m, end]

        best = (0, 0)
        for k in range(1, 6):
            for some in itertools.combinations(places, k):
                spans = sorted((e + 1 - widths[m], e) for m, e in some)
                if all(a[1] < b[0] for a, b in zip(spans, spans[1:])):
                    best = max(best, tuple(map(sum, zip(*(value(*p) for p in some)))))
        df = spark.createDataFrame([(1, m, e, k) for (m, e), k in draws.items()], "seq_id long, motif int, end long, n long")
        out = [(r.motif, r.s_end - 1) for r in G.centroid_sites(df, n, widths).collect()]
        spans = sorted((e + 1 - widths[m], e) for m, e in out)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert (tuple(map(sum, zip(*(value(*p) for p in out)))) if out else (0, 0)) == best


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000])
def test_permutations(n):
    orders = {tuple(S.permuted(n, key)) for key in range(30)}
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 5 or len(orders) > 20


def test_control_keeps_compositions(spark):
    nts = ["ACGT" * 50, "A", "", "AAXXNCCG", "X" * 400]
    q = spark.createDataFrame(list(enumerate(nts)) + [(9, None)], "seq_id long, nt string")
    got = {r.seq_id: r.nt for r in S.shuffled_control(q, 3).collect()}
    assert got == {r.seq_id: r.nt for r in S.shuffled_control(q.repartition(3), 3).collect()} and got != {r.seq_id: r.nt for r in S.shuffled_control(q, 4).collect()}
    assert Counter(got[0]) == Counter(nts[0]) and got[0] != nts[0] and got[1] == "A" and got[2] == got[9] == ""
    assert len(got[3]) == 8 and not set(got[3] + got[4]) & set("XN") and not Counter("AACCG") - Counter(got[3]) and min(Counter(got[4]).values()) > 50


def test_stretches_and_runs(spark):
    nts = ["ACGXXACXA", "XXX", "A", "", "ACGT"]
    q = spark.createDataFrame(list(enumerate(nts)), "seq_id long, nt string")
    assert sorted(map(tuple, S.valid_stretches(q).collect())) == [(0, 0, 3), (0, 5, 2), (0, 8, 1), (2, 0, 1), (4, 0, 4)]
    runs = {}
    for r in S.valid_runs(q).collect():
        runs.setdefault(r.seq_id, {})[r.pos] = r.run
    want = {i: {p: len(nt[: p + 1]) - 1 - nt[: p + 1].rfind("X") for p in range(len(nt))} for i, nt in enumerate(nts) if nt}
    assert runs == want
    assert S.valid_stretches(q).agg(F.sum("n")).first()[0] == sum(c != "X" for nt in nts for c in nt)
