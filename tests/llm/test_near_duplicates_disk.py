"""Near duplicates on little disk: shuffle files go with their write, and entries and pairs are found in arrays."""

from __future__ import annotations

import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkveil.llm import common, jaccard_join
from inkveil.llm.common import written


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.size()) if "/shuffle_" in str(files.apply(i))}


def test_written_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = written(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert sorted(r["k"] for r in rows.collect()) == list(range(7))


@pytest.mark.parametrize("whole", [True, False])
def test_entries_under_which_nodes_are_apart(whole):
    rng = np.random.default_rng(4)
    n = 400
    keys, nodes = rng.integers(0, 120, n), rng.integers(0, 60, n)
    groups, bands = nodes // 3, np.where(keys < 60, nodes % 4, -1)
    found = jaccard_join._under_common(keys, nodes, groups, bands, whole)
    under = {}
    for k, x, g, b in zip(keys.tolist(), nodes.tolist(), groups.tolist(), bands.tolist(), strict=True):
        for band in (b, b + 1) if b >= 0 else (None,):
            under.setdefault((k, band), set()).add((x, g))
    want = sorted((x, g) for members in under.values() if not whole or len({g for _, g in members}) > 1 for x, g in members)
    assert sorted(zip(found["node"].tolist(), found["component"].tolist(), strict=True)) == want
    assert found["single"].isna().any() and found["single"].notna().any()


def test_cells_give_each_pair_that_may_link_once():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, 150, dtype=np.uint64))]
    for _ in range(59):
        x = sets[rng.integers(0, len(sets))]
        sets.append(np.unique(np.concatenate((x[rng.random(len(x)) > 0.04], rng.integers(0, 1 << 63, 4, dtype=np.uint64)))))
    summaries = [jaccard_join._summary(s) if i % 9 else None for i, s in enumerate(sets)]
    rows = []
    for cell, members in enumerate([range(0, 30), range(20, 60), range(20, 60)]):
        rows += [(cell, 0 if cell == 0 or i % 2 else 1, cell == 0, i, i // 2, len(sets[i]), summaries[i]) for i in members]
    frame = pd.DataFrame(rows, columns=["cell", "block", "same", "node", "component", "n_shingles", "summary"])
    got = pd.concat(list(jaccard_join._cells(frame.sample(frac=1, random_state=1), 80)))
    got = list(zip(got["a"].tolist(), got["b"].tolist(), strict=True))
    pairs = {(a, b) for a in range(30) for b in range(a + 1, 30)} | {(a, b) for a in range(20, 60) for b in range(a + 1, 60) if a % 2 != b % 2}
    want = set()
    for a, b in pairs:
        m, n = sorted((len(sets[a]), len(sets[b])))
        if a // 2 != b // 2 and 100 * m >= 80 * n and jaccard_join._may_link(summaries[a], summaries[b], m + n, 80):
            want.add((a, b))
    assert len(got) == len(set(got)) and set(got) == want


def test_summaries_in_half_bytes_and_coarse_ones_rule_out_no_link():
    rng = np.random.default_rng(8)
    for n in (3, 90, 700):
        for same in (0.0, 0.5, 0.95, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate((x[rng.random(len(x)) < same], rng.integers(0, 1 << 63, 2, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            linked = 100 * both >= 85 * (len(x) + len(y) - both)
            fine = [jaccard_join._summary(s) for s in (x, y)]
            coarse = [jaccard_join._coarse(s) for s in fine]
            assert [int(jaccard_join._counts(s).sum()) for s in (*fine, *coarse)] == [len(x), len(y)] * 2
            assert len(fine[0]) <= jaccard_join._classes(fine[0]) // 2 + 1
            may = [jaccard_join._may_link(*s, len(x) + len(y), 85) for s in (fine, coarse)]
            assert (may[0] and may[1]) or not linked
            assert may[1] or not may[0]
    crowded = (np.arange(20, dtype=np.uint64) << np.uint64(40)) + np.uint64(1)
    assert jaccard_join._counts(jaccard_join._summary(crowded)).max() == 20
    assert jaccard_join._summary(np.arange(300, dtype=np.uint64) << np.uint64(40)) is None
    assert jaccard_join._coarse(None) is None


def test_near_duplicates_leave_no_index_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    base = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    texts = [*base, *[t.replace("x30", "changed") for t in base], *base[:5], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert all(rows[i] == rows[i + 40] == i for i in range(40)) and all(rows[80 + i] == i for i in range(5))
    left = {f.name.rpartition("-")[0] for f in tmp_path.iterdir()}
    assert left == {"every", "links"}
