import random

import numpy as np
import pytest

from voxframe.llm import components, neardup
from voxframe.llm.q_neardup import SQL, op3_neardup

from brute import near_components
from oracle import compare


def check(df, size):
    got = neardup.near_duplicates(df, size).collect()
    docs = {r.doc_id: r.text for r in df.select("doc_id", "text").collect() if r.doc_id is not None}
    comp, n = near_components(docs, size)
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (comp[r.doc_id], n[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_query_matches_sql(spark, sf_dir):
    compare(spark, sf_dir, op3_neardup, SQL)


def test_query_against_brute_force(spark, sf_dir, texts):
    comp, n = near_components(texts, 2)
    got = op3_neardup(spark, sf_dir).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {d: (comp[d], n[d], comp[d] == d) for d in texts}


def test_edge_cases(nasty, empty):
    check(nasty, 5)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.dedup(nasty)
    assert kept.columns == nasty.columns and {r.doc_id for r in kept.collect()} >= {22, 23, 24, 25}


@pytest.mark.parametrize("block", [4, neardup.BLOCK])
def test_hot_group_of_near_copies(spark, block, monkeypatch):
    """Edits of one text at all rates, so that many pairs are just under or over the threshold."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup.across, "__defaults__", (block,))
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        docs.append((k * 3, " ".join(w).upper() if k % 5 == 0 else " ".join(w)))
    check(spark.createDataFrame(docs, "doc_id long, text string"), 2)


def test_links_in_block_counts_shingles_that_hide_each_other():
    """Two sets of 10 share 9 of 11, but two of the shared ones have equal upper halves, so the halves alone say 8 of 10."""
    halves = np.arange(20, dtype=np.uint32)
    a, b = halves[:9], np.append(halves[:8], halves[10])
    both = lambda full: neardup.links_in_block(np.array([4, 2]), np.array([4, 2]), np.zeros(2, int), [a, b], np.array(full), 81)
    assert both([10, 10]) == [(2, 4)]
    assert both([9, 9]) == []


def test_links_in_block_does_not_join_components_by_chance():
    """Near the threshold, sets so large that some halves agree by chance leave every link to be confirmed."""
    n = 3_000_000
    shared = int(0.8001 * 2 * n / 1.8001)
    base = np.arange(n, dtype=np.uint32)
    sets = [base, np.append(base[:shared], np.arange(n, 2 * n - shared, dtype=np.uint32)), np.append(base[:shared], np.arange(2 * n, 3 * n - shared, dtype=np.uint32))]
    found = neardup.links_in_block(np.arange(3), np.arange(3), np.zeros(3, int), sets, np.full(3, n), 80)
    assert set(found) == {(0, 1), (0, 2), (1, 2)}


def test_links_in_block_finds_a_spanning_set():
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(40)], np.uint32)) for _ in range(40)]
    sets += [np.unique(np.append(s, rng.randrange(60))) for s in sets[:20]]
    n = len(sets)
    found = neardup.links_in_block(np.arange(n), np.arange(n), np.zeros(n, int), sets, np.array([len(s) for s in sets]), 80)
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[top(a)] = top(b)
    for a in range(n):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if neardup.alike(shared, len(sets[a]), len(sets[b]), 80):
                assert top(a) == top(b)


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 117)] + [(200, k) for k in range(201, 240)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    s = neardup.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12


def test_columns_named_like_the_operators_own_keep_their_values(spark):
    names = ["near__id", "near_id", "doc", "a", "b", "class_id", "component_id", "dealt", "bucket", "lead", "signature"]
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text + (" more" if k == 2 else ""), *[7] * len(names)) for k in range(3)] + [(9, "quite another text", *[7] * len(names))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = neardup.dedup(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 9] and all(out.where(f"`{n}` = 7").count() == 2 for n in names)


@pytest.mark.parametrize("size", [64, 16 << 20])
def test_blocks_bounded_in_bytes_find_the_same_links(spark, size, monkeypatch):
    """Groups that are near, not linked to, the least member of their buckets."""
    monkeypatch.setattr(neardup.across, "__kwdefaults__", {"block_bytes": size})
    rng = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    docs = [(0, " ".join(base))]
    for k in range(1, 40):
        w = base[:62] + [f"g{k % 4}-{i}" for i in range(38)]
        w[rng.randrange(100)] = f"e{k}"
        docs.append((k, " ".join(w)))
    check(spark.createDataFrame(docs, "doc_id long, text string"), 2)
