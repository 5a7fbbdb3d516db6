"""Likelihoods of aligned columns under a tree, by pruning over the distinct columns.

An alignment has a row for each column and leaf. The bases of all leaves at a column are its pattern, and there are far fewer patterns than
columns, so each is pruned once, for all equilibria at once, and joined back. A branch of length t turns the likelihoods l of a node
into e l + (1 - e) (pi . l) with e = exp(-k t) and k = 1 / (1 - sum of pi^2), which needs no matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions import nt as N

#: A node, its parent (null for the root), the length of the branch to it and, for a leaf, its name in the alignment.
EDGES = "node string, parent string, length double, leaf string"


def edge_rows(tree: DataFrame | list[tuple]) -> list[tuple]:
    """The rows of an edge table, children before their parents; a tree of one root is as small as its number of leaves."""
    rows = [tuple(r) for r in tree.select("node", "parent", "length", "leaf").collect()] if isinstance(tree, DataFrame) else tree
    by, depth = {r[0]: r for r in rows}, {n: 0 for n, parent, _, _ in rows if parent is None}
    while len(depth) < len(rows):
        more = {n: depth[p] + 1 for n, p, _, _ in rows if n not in depth and p in depth}
        if not more:
            raise ValueError("the tree has a cycle or a missing parent")
        depth |= more
    if sum(d == 0 for d in depth.values()) != 1:
        raise ValueError("a tree has one root")
    return [by[n] for n in sorted(depth, key=lambda n: (-depth[n], n))]


def leaves_of(rows: list[tuple]) -> list[str]:
    return sorted({leaf for *_, leaf in rows if leaf})


def pruned(codes: np.ndarray, rows: list[tuple], equilibria: np.ndarray) -> np.ndarray:
    """likelihood[pattern, equilibrium] of codes[pattern, leaf] (0 to 3 for the bases, 4 unknown) by edge_rows and equilibria[which, base]."""
    k = 1 / (1 - (equilibria**2).sum(axis=1))
    known = np.vstack([np.eye(4), np.ones(4)])
    names, at = leaves_of(rows), {}
    shape = (len(codes), len(equilibria), 4)
    for node, parent, length, leaf in rows:
        own = at.pop(node, None)
        if leaf:
            seen = np.broadcast_to(known[codes[:, names.index(leaf)]][:, None, :], shape)
            own = seen if own is None else own * seen
        own = np.ones(shape) if own is None else own
        if parent is None:
            return (own * equilibria).sum(axis=2)
        e = np.exp(-k * length)[None, :, None]
        up = e * own + (1 - e) * (own * equilibria).sum(axis=2, keepdims=True)
        at[parent] = at[parent] * up if parent in at else up
    return np.ones(shape[:2])


def patterns(columns: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """(keys, pattern): the bases of the leaves at each column, in the order of names; a leaf without a row, or with another letter, is '-'."""
    base = F.when(F.col("base").isin(*N.BASES), F.col("base")).otherwise("-")
    seen = columns.select(*keys, "leaf", base.alias("b")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("leaf", "b"))).alias("m"))
    return seen.select(*keys, F.array_join(F.array(*(F.coalesce(F.element_at("m", F.lit(x)), F.lit("-")) for x in names)), "").alias("pattern"))


def pattern_likelihoods(found: DataFrame, rows: list[tuple], equilibria: np.ndarray) -> DataFrame:
    """(pattern, likelihoods) of the distinct patterns: one for each of the equilibria."""
    letters = N.BASES

    def run(frames):
        for f in frames:
            codes = np.array([[letters.index(b) if b in letters else 4 for b in p] for p in f.pattern], dtype=np.int64).reshape(len(f), -1)
            yield pd.DataFrame({"pattern": f.pattern, "likelihoods": list(pruned(codes, rows, equilibria))})

    return found.select("pattern").distinct().mapInPandas(run, "pattern string, likelihoods array<double>")


def tree_column(columns: DataFrame, tree: DataFrame | list[tuple], pi: dict[str, float]) -> DataFrame:
    """(col, likelihood) of columns(col, leaf, base) over a tree of EDGES; a leaf without a row, or with a masked base, is unknown."""
    rows = edge_rows(tree)
    found = patterns(columns, leaves_of(rows), "col")
    known = pattern_likelihoods(found, rows, np.array([[pi[b] for b in N.BASES]]))
    return found.join(known, "pattern").select("col", F.col("likelihoods")[0].alias("likelihood"))


def tree_ratio(columns: DataFrame, tree: DataFrame | list[tuple], pwm: DataFrame, bg: DataFrame) -> DataFrame:
    """(aln, start, motif, ln_ratio) of each aligned place of columns(aln, col, leaf, base) where all columns of a site are there.

    The foreground of column i takes the probabilities of column i of the motif as its equilibrium, the background takes bg. A column is
    scored once for all models, and a place adds up those of its columns.
    """
    rows = edge_rows(tree)
    usual = {r.base: r.p for r in bg.collect()}  # four rows
    models: dict[int, dict[int, dict[str, float]]] = {}
    for r in pwm.select("motif", "col", "base", "p").collect():  # as many as the models have cells
        models.setdefault(r.motif, {}).setdefault(r.col, {})[r.base] = r.p
    cells = [(m, i) for m in sorted(models) for i in sorted(models[m])]
    equilibria = np.array([[usual[b] for b in N.BASES]] + [[models[m][i][b] for b in N.BASES] for m, i in cells])
    found = patterns(columns, leaves_of(rows), "aln", "col")
    known = pattern_likelihoods(found, rows, equilibria)
    logs = F.transform("likelihoods", lambda x: F.ln(x))
    gains = known.select("pattern", F.transform(F.slice(logs, 2, len(cells)), lambda x: x - F.element_at(logs, 1)).alias("gains"))
    scored = found.join(gains, "pattern").select("aln", "col", "gains")
    widths = {m: len(x) for m, x in models.items()}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("motif"), F.lit(i).alias("i"), F.lit(widths[m]).alias("w"), F.element_at("gains", k + 1).alias("x")) for k, (m, i) in enumerate(cells))))
    place = scored.select("aln", "col", each.alias("c")).select("aln", (F.col("col") - F.col("c.i")).cast("long").alias("start"), "c.motif", "c.w", "c.x")
    summed = place.groupBy("aln", "start", "motif", "w").agg(F.sum("x").alias("ln_ratio"), F.count("*").alias("n"))
    return summed.where("n = w").select("aln", "start", "motif", "ln_ratio")


def tree_unmatched(leaves: DataFrame, seqs: DataFrame) -> DataFrame:
    """(what, id): leaves(leaf) without a sequence and sequences without a leaf."""
    a = leaves.join(seqs.select(F.col("seq_id").alias("leaf")), "leaf", "left_anti").select(F.lit("leaf").alias("what"), F.col("leaf").alias("id"))
    b = seqs.select(F.col("seq_id").alias("leaf")).join(leaves, "leaf", "left_anti").select(F.lit("sequence").alias("what"), F.col("leaf").alias("id"))
    return a.union(b)
