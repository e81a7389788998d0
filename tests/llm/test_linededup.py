import random

from pyspark.sql import functions as F

from voxframe.llm import linededup as L
from voxframe.llm.q_linededup import op8_linededup, sql

from oracle import compare


def test_query_matches_sql(spark, sf_dir):
    compare(spark, sf_dir, op8_linededup, sql())


def parts(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", L.chunks(F.col("text")).alias("c"))
    return [[c.text for c in r.c] for r in df.orderBy("doc_id").collect()]


def test_chunks_put_together_are_the_text(spark):
    rng = random.Random(1)
    texts = ["\n".join(str(rng.randrange(20)) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", "\n", "a\n", "\n\n\n\n", "x\r\ny"]
    for t, p in zip(texts, parts(spark, *texts)):
        assert "\n".join(p) == t
        assert all(c.count("\n") >= 1 for c in p[:-1])


def test_boundaries_resist_shifts(spark):
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(200)]
    a, b = parts(spark, "\n".join(lines), "\n".join(["new", *lines[:90], "more", *lines[90:]]))
    assert len(set(a) & set(b)) > len(a) * 0.9


def test_later_copies_go_and_the_first_stays(spark):
    rng = random.Random(3)
    block = "\n".join(f"shared {rng.random()}" for _ in range(40))
    docs = [(7, block), (3, "intro\nof three\n" + block), (9, "a single line"), (10, "a single line"), (12, block)]
    got = {r.doc_id: r for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[3].text == docs[1][1] and got[3].chunks_removed == 0
    assert len(got[7].text) < len(block) * 0.3 and got[7].lines_removed > 25
    assert got[12].text == got[7].text or len(got[12].text) <= len(got[7].text)
    assert got[10].text == "a single line"


def test_edge_cases(nasty, empty):
    out = L.dedup(nasty)
    assert out.columns == [*nasty.columns, "chunks_removed", "lines_removed"] and out.count() == nasty.count()
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert got[22].text is None and got[23].text == "" and got[28].chunks_removed == 0 and got[29].lines_removed > 0
    assert L.dedup(empty).count() == 0
    same = nasty.where("doc_id is null").select("text")
    assert sorted(map(str, out.where("doc_id is null").select("text").collect())) == sorted(map(str, same.collect()))


def test_repeats_within_one_document(spark):
    t = "\n".join(["a1", "b2", "c3", "d4", "e5", "f6", "g7", "h8"] * 6)
    r = L.dedup(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")).collect()
    assert r[0] == r[1] and 0 < r[0].lines_removed < 48


def test_rows_with_equal_ids_and_other_texts_lose_nothing_of_their_own(spark):
    rng = random.Random(4)
    block = "\n".join(f"shared {rng.random()}" for _ in range(30))
    texts = [(1, block), (2, block), (2, "unique one\nunique two\n" + "\n".join(f"mine {rng.random()}" for _ in range(40))), (2, None)]
    got = sorted(((r.doc_id, r.text) for r in L.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()), key=str)
    kept = [t for d, t in got if d == 2]
    assert (1, block) in got and texts[2][1] in kept and None in kept
    assert sum(len(t or "") for t in kept) < len(block) * 0.3 + len(texts[2][1])


def test_columns_named_like_the_operators_own_keep_their_values(spark):
    names = ["chunks_removed", "lines_removed", "lines__gone", "lines__id", "lines_id", "lines_key", "lines_gone", "lines_new", "key", "k", "h", "chunk", "Gone"]
    block = "\n".join(f"shared {k * 7919 % 1000}" for k in range(40))
    docs = spark.createDataFrame([(k, block, *[7] * len(names)) for k in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = L.dedup(docs)
    assert out.columns == [*docs.columns, "chunks_removed_1", "lines_removed_1"] and all(out.where(f"`{n}` = 7").count() == 3 for n in names)
    assert [r.chunks_removed_1 > 0 for r in out.orderBy("doc_id").collect()] == [False, True, True]


def test_without_leaves_what_lies_between(spark):
    rng = random.Random(4)
    rows = [(n, sorted(rng.sample(range(n), rng.randint(0, n)))) for n in (0, 1, 2, 5, 9, 30) for _ in range(8)]
    df = spark.createDataFrame([(k, list(range(n)), gone) for k, (n, gone) in enumerate(rows)], "k int, parts array<int>, gone array<int>")
    got = {r.k: r.left for r in df.select("k", L.without(F.col("parts"), F.col("gone")).alias("left")).collect()}
    assert [got[k] for k in range(len(rows))] == [[x for x in range(n) if x not in gone] for n, gone in rows]
