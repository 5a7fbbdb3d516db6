"""Toxicity classifier with counterfactual regularisation (operator 9).

Features are the distinct words of a text and their beginnings of PREFIXES bytes, as 64-bit
fingerprints. Spark counts, over all labelled training rows, in how many toxic and other texts
each feature occurs; the FEATURES with the largest chi-square statistic are kept. A logistic
model is fitted on the FIT_ROWS labelled training rows with the smallest hashes of their ids (the one
bounded sample here). In training texts that name a group, each identity term is swapped for another
of its language and kind (chosen by a hash of the id and the place), and the squared change of the score's logit is penalised, so naming
a group neutrally does not make a text toxic.

Edge cases: null and empty texts have no features and score as the intercept; labels that are
null, or of rows that aren't in the table, are not used; a repeated doc_id in labels counts once;
without labels of both kinds every score is the share of toxic labels (0 without labels); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.shared import id_text, saved, table

PREFIXES, FEATURES, LEAST_CHI2, LEAST_TEXTS, FIT_ROWS = (3, 4, 5, 6, 7, 8), 3000, 12.0, 4, 20_000
#: Bytes of text at once: each word has seven features here.
SLICE = 1 << 19
STEPS, RATE, L2, SWAP_WEIGHT, THRESHOLD = 400, 0.1, 1e-4, 1.0, 0.7
#: Identity terms, in groups whose members replace each other.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african"), ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten"), ("schwule", "lesben", "heteros"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"), ("inmigrantes", "refugiados", "extranjeros"),
)


Groups = Sequence[Sequence[str]]


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def features(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), distinct, sorted."""
    w = t.words(K.NOT_ALNUM, K.FOLDED)
    size = w.end - w.start
    docs, found = [w.doc], [w.h]
    for k in PREFIXES:
        long = size > k
        docs.append(w.doc[long])
        found.append(K.mix64(K.spans_hash(t.data, w.start[long], w.start[long] + k, K.FOLDED) + K.U64(k)))
    doc, f = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((f, doc))
    doc, f = doc[order], f[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], f[new]


def term_features(term: str) -> np.ndarray:
    raw = pa.RecordBatch.from_pydict({"text": [term]})
    return features(K.Texts(raw))[1]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labelled rows of docs: ids alone meet here."""
    own = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(own, "doc_id")


def feature_counts(train: DataFrame) -> DataFrame:
    """(f, n, pos): in how many training texts, and toxic ones, a feature occurs."""

    def run(batches):
        for t in K.slices(batches, limit=SLICE):
            y = np.asarray(t.ids("y").to_numpy(zero_copy_only=False), dtype=np.int64)
            doc, f = features(t)
            order = np.argsort(f, kind="stable")
            f, hit = f[order], y[doc[order]]
            heads = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([heads, [len(f)]]))
            pos = np.add.reduceat(hit, heads) if len(heads) else heads
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(f[heads])), pa.array(n.astype(np.int64)), pa.array(pos.astype(np.int64))], ["f", "n", "pos"])

    return train.mapInArrow(run, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def chosen_features(train: DataFrame, total: int, toxic: int) -> np.ndarray:
    n, a = F.col("n").cast("double"), F.col("pos").cast("double")
    b, c, d = n - a, F.lit(float(toxic)) - a, F.lit(float(total - toxic)) - (n - a)
    chi2 = F.lit(float(total)) * (a * d - b * c) ** 2 / (n * F.lit(float(toxic)) * F.lit(float(total - toxic)) * (c + d) + F.lit(1e-9))
    best = feature_counts(train).where(F.col("n") >= LEAST_TEXTS).select("f", chi2.alias("x")).where(F.col("x") > LEAST_CHI2).orderBy(F.desc("x"), "f").limit(FEATURES)
    return np.sort(np.array([r.f for r in best.collect()], dtype=np.int64).view(K.U64))


def active(t: K.Texts, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place in chosen) of the chosen features of each text."""
    doc, f = features(t)
    if not len(chosen):
        return doc[:0], doc[:0]
    at = np.minimum(np.searchsorted(chosen, f), len(chosen) - 1)
    hit = chosen[at] == f
    return doc[hit], at[hit]


def swaps(chosen: np.ndarray, identity: Groups = IDENTITY) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Fingerprints of the identity terms, sorted, and for each its alternatives as changes of feature places (~place: gone)."""
    table_ = {}
    for group in identity:
        for term in group:
            own = [p for p in _places(term, chosen)]
            table_[int(_word(term))] = [np.array([*(~p for p in own), *_places(other, chosen)], dtype=np.int64) for other in group if other != term]
    keys = np.sort(np.array(list(table_), dtype=K.U64))
    return keys, [table_[int(k)] for k in keys]


def _word(term: str) -> np.ndarray:
    return K.Texts(pa.RecordBatch.from_pydict({"text": [term]})).words(K.NOT_ALNUM, K.FOLDED).h[0]


def _places(term: str, chosen: np.ndarray) -> list[int]:
    f = term_features(term)
    at = np.searchsorted(chosen, f)
    return [int(a) for a, x in zip(at, f) if a < len(chosen) and chosen[a] == x]


def swap_numbers(doc_ids: np.ndarray, named: np.ndarray, doc: np.ndarray) -> list[int]:
    """A number for each identity term, from its text's id and its place among the text's terms, so that batches don't matter."""
    of = doc[named]
    rank = np.arange(len(named)) - np.searchsorted(of, of)
    with np.errstate(over="ignore"):
        return K.mix64(doc_ids[of].astype(K.U64) * K.BASE + rank.astype(K.U64)).tolist()


def fit(docs: DataFrame, labels: DataFrame, swap_weight: float = SWAP_WEIGHT, identity: Groups = IDENTITY) -> Model:
    """The model learned from labels(doc_id, toxic) of docs(doc_id, text). identity: groups of terms that replace each other."""
    known = saved(labelled(docs, labels.select("doc_id", "toxic")), "labelled")
    total, toxic = known.agg(F.count("*"), F.sum("y")).first()
    toxic = toxic or 0
    if not 0 < toxic < total:
        share = toxic / total if total else 0.0
        return Model(np.zeros(0, K.U64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    each = known.distinct()
    texts = id_text(docs)
    # labels grow with the texts, so they are never sent to all tasks, however few they are
    chosen = chosen_features(texts.join(each.hint("merge"), "doc_id"), total, toxic)
    terms, others = swaps(chosen, identity)

    def run(batches):
        for t in K.slices(batches, limit=SLICE):
            doc, at = active(t, chosen)
            w = t.words(K.NOT_ALNUM, K.FOLDED)
            named = np.flatnonzero(np.isin(w.h, terms))
            change: list[list[int]] = [[] for _ in range(t.n)]
            numbers = swap_numbers(t.ids().to_numpy(zero_copy_only=False), named, w.doc)
            for i, number in zip(named.tolist(), numbers):
                alternatives = others[int(np.searchsorted(terms, w.h[i]))]
                change[int(w.doc[i])] += alternatives[number % len(alternatives)].tolist()
            counts = np.bincount(doc, minlength=t.n)
            yield pa.RecordBatch.from_arrays([t.ids("y"), K.lists(at, counts, pa.int64()), pa.array(change, pa.list_(pa.int64()))], ["y", "at", "change"])

    # FIT_ROWS ids at most, so they may be sent to the texts
    sample = F.broadcast(each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = texts.join(sample, "doc_id").mapInArrow(run, "y int, at array<long>, change array<long>").limit(2 * FIT_ROWS).collect()
    weights, bias = logistic([r.at for r in rows], [r.y for r in rows], [r.change for r in rows], len(chosen), swap_weight)
    return Model(chosen, weights, bias)


def logistic(rows: list, y: list, changes: list, n: int, swap_weight: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + L2 + swap_weight * mean squared logit change, by Adam."""
    y = np.array(y, dtype=float)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.fromiter((x for r in rows for x in r), dtype=np.int64)
    swapped = [c for c in changes if c]
    c_of = np.repeat(np.arange(len(swapped)), [len(c) for c in swapped])
    c_all = np.fromiter((x for c in swapped for x in c), dtype=np.int64)
    c_sign, c_at = np.where(c_all < 0, -1.0, 1.0), np.where(c_all < 0, ~c_all, c_all)
    w = np.zeros(n + 1)
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(of, weights=w[at], minlength=len(y)) + w[n]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.zeros(n + 1)
        g[:n] = np.bincount(at, weights=miss[of], minlength=n) / len(y) + 2 * L2 * w[:n]
        g[n] = miss.mean()
        if len(swapped):
            moved = np.bincount(c_of, weights=c_sign * w[c_at], minlength=len(swapped))
            g[:n] += 2 * swap_weight * np.bincount(c_at, weights=c_sign * moved[c_of], minlength=n) / len(swapped)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from 0 to 1, of every row of docs(doc_id, text)."""

    def run(batches):
        for t in K.slices(batches, limit=SLICE):
            doc, at = active(t, model.features)
            z = np.bincount(doc, weights=model.weights[at], minlength=t.n) + model.bias
            yield pa.RecordBatch.from_arrays([t.ids(), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""

    def run(batches):
        for t in K.slices(batches, text, SLICE):
            doc, at = active(t, model.features)
            z = np.bincount(doc, weights=model.weights[at], minlength=t.n) + model.bias
            yield t.rows.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def learned(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    """The model of the training folds of a folder's labels; texts come from its documents."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit(docs.where(remainder(3) != 1), table(spark, sf_dir, "labels").where(remainder(3) != 1))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), learned(spark, sf_dir))
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
