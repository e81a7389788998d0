import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxframe.llm import mixing
from voxframe.llm.q_mixing import op4_mixing, sql

from brute import mixed, uniform
from oracle import compare


def test_query_matches_sql(spark, sf_dir):
    compare(spark, sf_dir, op4_mixing, sql())


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1, 5; a stops at 30, c at 0, null at 270; b takes the rest
    assert got == {"a": 30.0, "b": 800.0, "c": 0.0, None: 270.0}
    assert sum(got.values()) == 1100


def test_totals_come_near_targets_and_reruns_agree(spark):
    rows = [(k, f"s{k % 4}", 1 + (k * 7919) % 500) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df)
    per = got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r.n - r.t) < 0.001 * r.t + 3 for r in per)
    assert got.where("copies > 3").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_small_and_large_range_counts_agree(spark):
    df = spark.createDataFrame([(k, "ab"[k % 3 == 0], k % 50) for k in range(500)], "doc_id long, source string, size long")
    rows = lambda n: sorted((r.doc_id, r.copies) for r in mixing.mix(df, buckets=n).collect())
    assert rows(1) == rows(1024)


def test_edge_cases(nasty, empty):
    got = mixing.mix(mixing.sized(nasty)).collect()
    assert len(got) == nasty.count() and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mix(mixing.sized(empty)).count() == 0 and mixing.apply(empty).count() == 0
    out = mixing.apply(nasty)
    assert out.columns == nasty.columns
    want = {}
    for r in got:
        want[r.doc_id, r.source, r.size] = want.get((r.doc_id, r.source, r.size), 0) + r.copies
    have = {(r.doc_id, r.source, r.size): r.n for r in out.select("doc_id", "source", mixing.words_in(F.col("text")).alias("words")).groupBy("doc_id", "source", F.col("words").alias("size")).agg(F.count("*").alias("n")).collect()}
    assert have == {k: n for k, n in want.items() if n}
    assert mixing.mix(mixing.sized(nasty.where("text is null"))).where("target != 0").count() == 0


def test_inclusion_follows_the_share_and_the_seed(spark):
    df = spark.createDataFrame([(k, "a", 10) for k in range(400)] + [(1000, "b", 4000)], "doc_id long, source string, size long")
    one, two = ({r.doc_id for r in mixing.mix(df, weights=(1, 3), seed=s).where("source = 'a' and copies > 0").collect()} for s in ("x", "y"))
    assert len(one) == len(two) == 200 and 60 < len(one & two) < 140


def some_rows(n=900):
    rng = random.Random(3)
    return [(k, "abcd"[min(3, rng.randrange(9))], int(10 ** rng.uniform(0, 3.3))) for k in range(n)]


@pytest.mark.parametrize("seed", ["mix1", "other"])
def test_against_a_sorted_draw(spark, seed):
    df = spark.createDataFrame(some_rows(), "doc_id long, source string, size long")
    assert {r.doc_id: r.copies for r in mixing.mix(df, seed=seed).collect()} == mixed(some_rows(), seed=seed)[0]


def test_inclusion_probabilities_differ_by_length_and_hold_over_seeds():
    """Over 200 seeds a length class is taken as often as its expected copies say; longer ones more often. What ends the prefix
    is a longer document more often than not: with hundreds of documents a source that takes up to 0.02 from a class."""
    rows, times = some_rows(4000), 200
    taken: Counter = Counter()
    for k in range(times):
        got, each = mixed(rows, seed=str(k))
        taken.update(got)
    by_class: dict = {}
    for d, s, n in rows:
        by_class.setdefault((s, n.bit_length()), []).append((taken[d] / times, each[d]))
    for have in by_class.values():
        if len(have) >= 10:
            assert abs(sum(h - e for h, e in have) / len(have)) < 0.03
    share = {c: have[0][1] for (s, c), have in by_class.items() if s == "d"}
    assert len({round(v, 6) for v in share.values()}) > 3 and share[max(share)] > share[min(share)]


def test_rows_without_doc_id_draw_from_their_texts(spark):
    docs = spark.createDataFrame([(None, f"w{k} " * 5, "a") for k in range(200)] + [(1, "x " * 1000, "b")], "doc_id long, text string, source string")
    out = mixing.apply(docs, weights=(1, 3))
    assert out.columns == docs.columns and 80 <= out.where("source = 'a'").count() <= 120


def test_columns_named_like_the_operators_own_keep_their_values(spark):
    names = ["mixed", "u", "class", "copies", "rank", "open", "sure", "cut", "pick", "of", "in", "size", "mix__0", "mix__copy"]
    docs = spark.createDataFrame([(k, f"w{k} " * 9, f"s{k % 2}", *[7] * len(names)) for k in range(60)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.apply(docs)
    assert out.columns == docs.columns and out.count() > 0 and all(out.where(f"`{n}` != 7").count() == 0 for n in names)


def test_uniform_is_that_of_the_plain_version(spark):
    got = spark.range(50).select("id", mixing.uniform(F.col("id"), F.lit(None).cast("string"), "s").alias("u")).collect()
    assert all(r.u == uniform(r.id, "s") for r in got)
