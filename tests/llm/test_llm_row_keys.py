"""Null and repeated doc_ids: operators and stages that decide by row treat each row by itself."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixlake.llm import contamination, licenses, minhash, shared
from tests.llm.test_llm_operators import brute_components, brute_contamination

ITEM = " ".join(f"leak{i}" for i in range(14))
BASE = " ".join(f"tok{i}" for i in range(80))
NEAR = BASE.replace("tok40", "other")
NOTICE = licenses.TEMPLATES["mit-grant"]
ROWS = [
    (None, f"before {ITEM} after"), (None, "nothing here"), (None, None), (None, None), (None, BASE), (None, NEAR), (None, BASE), (3, f"see {ITEM}"), (3, "nothing here"),
    (3, "nothing here"), (4, BASE), (4, NEAR), (4, BASE), (5, NOTICE), (5, "no notice"), (None, NOTICE), (6, ""), (6, "   "), (7, "one two three four five six seven eight"),
    (8, "one two three four five six seven eight"), (None, "all alone are these words without any id here"), (9, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, row_key int").repartition(3)


def test_row_key(spark, rows):
    key, unique = shared.row_key(rows)
    found = {(r.doc_id, r.text): r.k for r in rows.select("doc_id", "text", key.alias("k")).collect()}
    assert not unique and len(set(found.values())) == len(set(ROWS)) and None not in found.values()
    own = rows.where("doc_id > 6").withColumn("doc_id", F.col("doc_id").cast("int"))
    assert shared.row_key(own)[1] and shared.row_key(rows.where("false"))[1]


def test_contamination(spark, rows):
    want = brute_contamination({i: t for i, (_, t) in enumerate(ROWS)}, {1: ITEM})
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    got = contamination.contamination(rows, items).select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "n_near").collect()
    # of a row only doc_id is told, so rows are compared as a multiset
    assert Counter(map(tuple, got)) == Counter((d, *want[i]) for i, (d, _) in enumerate(ROWS))
    assert sum(r.contaminated for r in got) == 2


def test_licenses(rows):
    got = licenses.license_rows(rows).collect()
    assert len(got) == len(ROWS)
    assert Counter((r.doc_id, r.n_matches) for r in got) == Counter((d, int(t == NOTICE)) for d, t in ROWS)


def test_minhash(rows):
    order = sorted(set(ROWS), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    place = {r: i for i, r in enumerate(order)}
    want = brute_components({i: t for i, (_, t) in enumerate(order)})
    got = minhash.near_duplicates(rows).collect()
    known = Counter((d, want[place[d, t]][0], order[want[place[d, t]][1]][0]) for d, t in ROWS)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == known
    key, unique = shared.row_key(rows)
    kept = {r.row_key for r in minhash.near_duplicate_rows(rows, key, unique).where("kept").collect()}
    texts = {r.k: (r.doc_id, r.text) for r in rows.select("doc_id", "text", key.alias("k")).collect()}
    per = Counter(want[place[texts[k]]][1] for k in kept)
    assert set(per) == {w[1] for w in want.values()} and set(per.values()) == {1} and all(r.kept is not None for r in got)


def test_stages(spark, rows, sf_dir):
    """One row stays of each group of near-duplicates, and every row that holds a benchmark item goes."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    item = shared.table(spark, sf_dir, "benchmark").where("length(text) > 80").first().text
    docs = rows.withColumn("text", F.regexp_replace("text", ITEM, item)).withColumn("_gone", F.lit(2)).withColumn("_row_key", F.lit(3))
    out = stages["minhash_near_dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    copies = [t for _, t in got.elements() if t in (BASE, NEAR)]
    assert len(copies) == 1 and got[4, copies[0]] == 1 and all(got[r] == Counter(ROWS)[r] for r in ROWS if not (r[1] or "").strip())
    assert got[7, ROWS[18][1]] == 1 and got[8, ROWS[18][1]] == 0
    # short texts without a copy stay, once each
    assert sum(n for (_, t), n in got.items() if t == "nothing here") == 1
    out = stages["benchmark_decontamination"](spark, docs, sf_dir)
    left = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == docs.columns and left == Counter(r for r in ROWS if ITEM not in (r[1] or ""))
    assert sum(left.values()) == len(ROWS) - 2
