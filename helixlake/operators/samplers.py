"""Gibbs samplers over sequences, as Spark jobs.

A sequence's dynamic program is a few cumulative sums: s_k = cumsum(sum over models of ratio * s_{k-1}
shifted by the width), so it runs in NumPy inside tasks. Random numbers come from counters (seed, walk, iteration,
sequence), so results don't depend on partitions. Chains over many sequences and walks are in chains.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import nt as N
from helixlake.sources.store import stored

PSEUDO = 0.28
CODES = np.full(256, 4, np.int8)
for _i, _b in enumerate("ACGT"):
    CODES[ord(_b)] = _i


@dataclass
class Config:
    widths: tuple[int, ...] = (6, 6)
    max_sites: int = 2
    blocks: tuple[float, ...] | None = None  # prior of 0..max_sites sites
    burn_in: int = 2
    samples: int = 3
    seed: int = 1
    k_mode: str = "posterior"  # or "prior": the number of sites is drawn from the placement prior
    shift_period: int = 5  # sweeps between shift moves; 0: none
    max_shift: int = 2

    def prior(self) -> np.ndarray:
        b = np.array(self.blocks or [0.1] + [0.9 / self.max_sites] * self.max_sites)
        return b / b.sum()


def codes_of(nt: str) -> np.ndarray:
    return CODES[np.frombuffer(nt.encode("ascii", "replace"), np.uint8)]


def rng_of(*counter: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([int(c) & 0xFFFFFFFF for c in counter])))


def keys_of(seed: int, walks: list[int], it: int, seqs: list[int]) -> np.ndarray:
    """By sequence and walk the key that rng_of(seed, walk, it, seq) takes, two 64-bit numbers."""
    mask = 0xFFFFFFFF
    of = lambda *counters: np.array([int(c) & mask for c in counters], np.uint64)
    counters = np.broadcast_arrays(of(seed)[:, None], of(*walks)[None], of(it)[:, None], of(*seqs)[:, None])
    # the hashes of SeedSequence, for all of them at once, in 64 bits of which 32 are kept
    const = 0x43B0D7E5

    def hashed(x: np.ndarray, by: int = 0x931E8875) -> np.ndarray:
        nonlocal const
        x = x ^ np.uint64(const)
        const = const * by & mask
        x = x * np.uint64(const) & np.uint64(mask)
        return x ^ (x >> np.uint64(16))

    pool = [hashed(x) for x in counters]
    for i in range(4):
        for j in range(4):
            if i != j:
                x = (np.uint64(0xCA01F9DD) * pool[j] - np.uint64(0x4973F715) * hashed(pool[i])) & np.uint64(mask)
                pool[j] = x ^ (x >> np.uint64(16))
    const = 0x8B51F9DD
    words = [hashed(x, 0x58F38DED) for x in pool]
    return np.stack([words[0] | words[1] << np.uint64(32), words[2] | words[3] << np.uint64(32)], axis=-1)


def rngs_of(keys: np.ndarray) -> Iterator[np.random.Generator]:
    """One generator that is set anew to each of keys: it is to be used before the next one is asked for."""
    bits = np.random.Philox(key=0)
    rng, state = np.random.Generator(bits), bits.state
    for key in keys:
        state["state"]["key"] = key
        bits.state = state
        yield rng


def ratios(codes: np.ndarray, log_odds: list[np.ndarray]) -> list[np.ndarray]:
    """For each model, at each inclusive end, foreground over background; 0 where a masked base or the beginning is in the way."""
    out = []
    for m in log_odds:
        w = len(m)
        r = np.zeros(len(codes))
        if len(codes) >= w:
            full = np.vstack([m.T, np.full(w, -np.inf)])  # code 4: masked
            total = np.zeros(len(codes) - w + 1)
            for c in range(w):
                total += full[codes[c : len(codes) - w + 1 + c], c]
            r[w - 1 :] = np.exp(total)
            r[0] = 0
        out.append(r)
    return out


def forward(r: list[np.ndarray], widths, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """s[k][..., j]: weight of k sites that end at j or before; step[k][m, ..., j]: of those whose last site is of model m and ends at j. Axes before the last are independent."""
    shape, n = r[0].shape, r[0].shape[-1]
    s, steps = [np.ones(shape)], [np.zeros((len(r), *shape))]
    for _ in range(k):
        step = np.zeros((len(r), *shape))
        for m, w in enumerate(widths):
            step[m] = r[m]
            if len(s) > 1:
                step[m][..., : min(w, n)] = 0
                step[m][..., w:] *= s[-1][..., : max(n - w, 0)]
        steps.append(step)
        s.append(np.cumsum(step.sum(0), axis=-1))
    return s, steps


def site_weights(totals: list[float] | list[np.ndarray], places: list[float], cfg: Config) -> np.ndarray:
    """Weights of 0, 1, ... sites from the summed odds and the number of placements of as many; totals may be columns of many walks."""
    if cfg.k_mode == "prior":
        weight = cfg.prior() * np.array([float(x > 0) for x in places])
        return weight if np.ndim(totals[0]) == 0 else np.tile(weight, (len(totals[0]), 1))
    if np.ndim(totals[0]) == 0:
        return cfg.prior() * np.array([x / max(y, 1) for x, y in zip(totals, places)])
    return cfg.prior() * (np.concatenate(totals, axis=1) / np.maximum(places, 1))


def traced(s, steps, widths, weight: np.ndarray, most: int, rng) -> list[tuple[int, int]]:
    """(model, inclusive end) of one draw of sites, by tracing back the forward sums."""
    n = len(s[0])
    if not n:
        return []
    k = int(weight.cumsum().searchsorted(rng.random() * weight.sum(), side="right"))
    out, limit = [], n - 1
    for j in range(min(k, most), 0, -1):
        total = s[j][limit] if limit >= 0 else 0
        if total <= 0:
            break
        end = int(s[j][: limit + 1].searchsorted(rng.random() * total, side="right"))
        part = steps[j][:, end]
        model = int(part.cumsum().searchsorted(rng.random() * part.sum(), side="right"))
        out.append((model, end))
        limit = end - widths[model]
    return out[::-1]


def draw_sites(r, widths, cfg: Config, rng) -> list[tuple[int, int]]:
    """A draw of sites by the ratios of one sequence."""
    if not len(r[0]):
        return []
    s, steps = forward(r, widths, cfg.max_sites)
    c, _ = forward([(x > 0).astype(float) for x in r], widths, cfg.max_sites)
    return traced(s, steps, widths, site_weights([x[-1] for x in s], [x[-1] for x in c], cfg), cfg.max_sites, rng)


def background_array(bg: DataFrame) -> np.ndarray:
    p = {r.base: r.p for r in bg.collect()}  # four rows
    return np.array([p[b] for b in N.BASES])


def model_arrays(pwm: DataFrame, bg: np.ndarray) -> list[np.ndarray]:
    """Log odds of each motif in order; a model has at most a few dozen columns."""
    rows = pwm.toPandas()
    return [np.log(g.pivot(index="col", columns="base", values="p")[list(N.BASES)].to_numpy() / bg) for _, g in rows.groupby("motif")]


def count_placements(seqs: DataFrame, widths: tuple[int, ...], k: int) -> DataFrame:
    """(seq_id, k, n): ways to place k sites that don't overlap."""

    def run(frames):
        for f in frames:
            rows = []
            for seq, nt in zip(f.seq_id, f.nt):
                ok = ratios(codes_of(nt), [np.zeros((w, 4)) for w in widths])
                s, _ = forward(ok, widths, k)
                rows += [(seq, j, float(x[-1]) if len(x) else float(j == 0)) for j, x in enumerate(s)]
            yield pd.DataFrame(rows, columns=["seq_id", "k", "n"])

    return seqs.select("seq_id", "nt").mapInPandas(run, "seq_id long, k int, n double")


def forward_dp(seqs: DataFrame, pwm: DataFrame, bg: DataFrame, k: int) -> DataFrame:
    """(seq_id, k, total): summed odds of all placements of k sites."""
    p = background_array(bg)
    models = model_arrays(pwm, p)
    widths = tuple(len(m) for m in models)

    def run(frames):
        for f in frames:
            rows = []
            for seq, nt in zip(f.seq_id, f.nt):
                s, _ = forward(ratios(codes_of(nt), models), widths, k)
                rows += [(seq, j, float(x[-1]) if len(x) else float(j == 0)) for j, x in enumerate(s)]
            yield pd.DataFrame(rows, columns=["seq_id", "k", "total"])

    return seqs.select("seq_id", "nt").mapInPandas(run, "seq_id long, k int, total double")


def sample_sites(seqs: DataFrame, pwm: DataFrame | None, bg: DataFrame, cfg: Config, walk: int = 0) -> DataFrame:
    """One draw of sites for each sequence; without pwm, uniform over placements."""
    p = background_array(bg)
    models = model_arrays(pwm, p) if pwm is not None else [np.zeros((w, 4)) for w in cfg.widths]
    widths = tuple(len(m) for m in models)

    def run(frames):
        for f in frames:
            rows = []
            for seq, nt in zip(f.seq_id, f.nt):
                found = draw_sites(ratios(codes_of(nt), models), widths, cfg, rng_of(cfg.seed, walk, 0, seq))
                rows += [(seq, slot, m, end + 1 - widths[m], end + 1) for slot, (m, end) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["seq_id", "slot", "motif", "s_start", "s_end"])

    return seqs.select("seq_id", "nt").mapInPandas(run, "seq_id long, slot int, motif int, s_start long, s_end long")


def init_uniform(seqs: DataFrame, bg: DataFrame, cfg: Config, walk: int = 0) -> DataFrame:
    return sample_sites(seqs, None, bg, cfg, walk)


def one_site(scan: DataFrame, seed: int) -> DataFrame:
    """Exactly one site for each motif and sequence, drawn by the Gumbel-max rule over a scan(seq_id, end, motif, ratio)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "seq_id", "end", "motif"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scan.groupBy("seq_id", "motif").agg(F.max_by("end", F.ln("ratio") - F.ln(-F.ln(u))).alias("end"))


def shift_move(sites: DataFrame, seqs: DataFrame, bg: DataFrame, w: int, max_shift: int, seed: int) -> DataFrame:
    """Sites, none overlapping, with each motif in turn moved by the shift of -max_shift..max_shift that a draw by its model's likelihood picks.

    A site stays where it would leave its sequence, meet a masked base, or overlap the next site on its way, be it of another motif or
    one of its own that stays itself; the others move. One aggregation counts the columns of all shifts.
    """
    out = sites
    for m in sorted(r.motif for r in sites.select("motif").distinct().collect()):  # as many as there are models
        out = stored(shifted_motif(out, m, seqs, bg, w, max_shift, seed), "shifted")
    return out


def shifted_motif(sites: DataFrame, motif: int, seqs: DataFrame, bg: DataFrame, w: int, max_shift: int, seed: int) -> DataFrame:
    """shift_move of one motif."""
    low = F.greatest(F.col("s_start") - max_shift, F.lit(0))
    # only a site's surroundings go with its shifts
    near = sites.join(seqs.select("seq_id", F.length("nt").alias("_len"), "nt"), "seq_id").withColumn("_low", low).withColumn("_part", F.substring(F.col("nt"), (low + 1).cast("int"), F.lit(w + 2 * max_shift))).drop("nt")
    each = near.withColumn("_shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))))
    at, own = F.col("s_start") + F.col("_shift"), F.col("motif") == motif
    inside = F.when((at >= 0) & (at + w <= F.col("_len")), F.substring(F.col("_part"), (at - F.col("_low") + 1).cast("int"), F.lit(w)))
    ahead_first = Window.partitionBy("seq_id", "_shift").orderBy(F.signum("_shift") * F.col("s_start") * -1)
    each = each.withColumn("_ahead", F.lag(F.struct("motif", "s_start")).over(ahead_first)).withColumn("_site", inside)
    meets = F.col("_ahead").isNotNull() & (F.abs(at - F.col("_ahead.s_start")) < w)
    tight = F.coalesce(own & (F.col("_ahead.motif") == motif) & meets, F.lit(False))
    stuck = ~own | ~F.coalesce(F.col("_site").rlike("^[ACGT]+$"), F.lit(False)) | (meets & (F.col("_ahead.motif") != motif))
    # sites that can only move together follow one another; behind one that stays all stay
    each = each.withColumn("_chain", F.sum(F.when(tight, 0).otherwise(1)).over(ahead_first.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_stuck", stuck)
    behind = Window.partitionBy("seq_id", "_shift", "_chain").orderBy(F.signum("_shift") * F.col("s_start") * -1).rowsBetween(Window.unboundedPreceding, 0)
    by = F.when(F.max("_stuck").over(behind), 0).otherwise(F.col("_shift"))
    each = each.withColumn("_by", by).withColumn("_now", F.substring(F.col("_part"), (F.col("s_start") + F.col("_by") - F.col("_low") + 1).cast("int"), F.lit(w)))
    each = stored(each.drop("_part", "_site", "_ahead", "_chain", "_stuck", "_len", "_low"), "shifts")
    counts = each.where(own).select("_shift", F.posexplode(F.split("_now", "")).alias("col", "base")).where("base != ''").groupBy("_shift", "col", "base").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("_shift", "col"))
    ll = counts.withColumn("t", total).join(F.broadcast(bg.withColumnRenamed("p", "q")), "base").groupBy("_shift").agg(F.sum(F.col("n") * F.ln((F.col("n") + PSEUDO) / (F.col("t") + 4 * PSEUDO) / F.col("q"))).alias("ll"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(motif), "_shift"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    best = ll.agg(F.max_by("_shift", F.struct(F.col("ll") - F.ln(-F.ln(u)), -F.abs("_shift"))).alias("_shift"))  # one row
    out = each.join(F.broadcast(best), "_shift").withColumn("s_start", F.col("s_start") + F.col("_by"))
    if "s_end" in sites.columns:
        out = out.withColumn("s_end", F.col("s_start") + w)
    if "site" in sites.columns:
        out = out.withColumn("site", F.col("_now"))
    return out.select(*sites.columns)


def centroid_sites(samples: DataFrame, n_samples: int | None, widths: int | tuple[int, ...]) -> DataFrame:
    """(seq_id, motif, s_start, s_end, p): the sites that disagree least with all draws.

    samples(seq_id, motif, end, n), motif being 0 without that column; widths: of each motif; n_samples draws, or as many as a sequence has sites if it
    is None (draws of one site). A site of any drawn place scores 2 * overlaps - draws, where a draw overlaps when it shares more than
    half of the wider of both; the best set that doesn't overlap is a weighted interval choice over the places in order. Of sets that score
    alike the one with more draws at the very places wins, then the one with the earlier last site.
    """
    width_of = (widths,) if isinstance(widths, int) else tuple(widths)
    if "motif" not in samples.columns:
        samples = samples.withColumn("motif", F.lit(0))

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        n = f.groupby(["end", "motif"]).n.sum().sort_index()
        ends, motifs, times = (np.asarray(x, dtype=np.int64) for x in (n.index.get_level_values(0), n.index.get_level_values(1), n.to_numpy()))
        low = int(ends.min()) - max(width_of)
        sums = np.zeros((len(width_of), int(ends.max()) - low + 2), np.int64)
        np.add.at(sums, (motifs, ends - low + 1), times)
        sums = np.cumsum(sums, axis=1)  # sums[m, x - low + 1]: draws of motif m that end at x or before
        near = np.zeros(len(ends), np.int64)
        for i, (end, m) in enumerate(zip(ends.tolist(), motifs.tolist())):
            for other, w2 in enumerate(width_of):
                need = max(width_of[m], w2) // 2 + 1
                if need <= min(width_of[m], w2):
                    first, last = end - width_of[m] + need, end + w2 - need
                    near[i] += sums[other, min(last - low + 1, sums.shape[1] - 1)] - sums[other, max(first - low, 0)]
        draws = n_samples or int(times.sum())
        best: list[tuple[int, int]] = [(0, 0)]
        taken, before = [], np.searchsorted(ends, ends - np.array([width_of[m] for m in motifs]), side="right").tolist()
        for i in range(len(ends)):
            score, same = best[before[i]]
            with_i = (score + 2 * int(near[i]) - draws, same + int(times[i]))
            taken.append(with_i > best[-1])
            best.append(max(best[-1], with_i))
        rows, i = [], len(ends) - 1
        while i >= 0:
            if taken[i]:
                rows.append((int(f.seq_id.iloc[0]), int(motifs[i]), int(ends[i]) + 1 - width_of[motifs[i]], int(ends[i]) + 1, float(min(near[i] / draws, 1.0))))
                i = before[i] - 1
            else:
                i -= 1
        return pd.DataFrame(rows[::-1], columns=["seq_id", "motif", "s_start", "s_end", "p"])

    return samples.select("seq_id", F.col("motif").cast("int").alias("motif"), "end", "n").groupBy("seq_id").applyInPandas(choose, "seq_id long, motif int, s_start long, s_end long, p double")


def credibility(distances: DataFrame, q: float = 0.95) -> DataFrame:
    """(seq_id, q, distance, mean): the order statistic at floor(q * N) of distances(seq_id, sample, distance), not interpolated."""
    w = Window.partitionBy("seq_id").orderBy("distance", "sample")
    ranked = distances.withColumn("i", F.row_number().over(w) - 1).withColumn("at", F.least(F.floor(F.lit(q) * F.count("*").over(Window.partitionBy("seq_id"))), F.count("*").over(Window.partitionBy("seq_id")) - 1))
    return ranked.groupBy("seq_id").agg(F.lit(q).alias("q"), F.max(F.when(F.col("i") == F.col("at"), F.col("distance"))).alias("distance"), F.avg("distance").alias("mean"))
