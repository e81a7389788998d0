import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import substrings as S
from voxframe.llm import words
from voxframe.llm.q_substrings import SQL, op2_substrings

from brute import WORD, longest_repeat, windows_removed
from oracle import compare


def check(df, size=13):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted((str(d), *w) for (d, _), w in zip(rows, windows_removed(rows, size)))
    got = S.repeated_windows(df, size).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    return got, rows


def test_query_matches_sql(spark, sf_dir):
    compare(spark, sf_dir, op2_substrings, SQL)


def test_query_against_brute_force(spark, sf_dir, texts):
    rows = sorted(texts.items())
    want = {d: w for (d, _), w in zip(rows, windows_removed(rows))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substrings(spark, sf_dir).collect()} == want


def test_edge_cases(nasty, empty):
    check(nasty)
    assert S.repeated_windows(empty).count() == 0
    assert S.repeated_windows(nasty.where("text is null")).count() == 2


def test_levels_against_definition(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passage, other = text(70), text(30)
    docs = [(k, text(20) + (passage if k % 2 else []) + (other if k % 3 == 0 else []) + text(10)) for k in range(12)]
    docs += [(50, docs[1][1]), (51, passage[:25])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    got, rows = check(df, 5)
    assert {r.doc_id: r.longest_repeat for r in got} == longest_repeat(rows, 5)


def test_many_small_parts_and_buckets_agree(spark, monkeypatch):
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(20)) for _ in range(6)]
    df = spark.createDataFrame([(rng.choice([k, k * 10**12]), " ".join(rng.sample(pool, 3))) for k in range(150)], "doc_id long, text string")
    monkeypatch.setattr(S, "PART_WORDS", 20)
    monkeypatch.setattr(S, "BUCKET_WORDS", 100)
    monkeypatch.setattr(S, "MESSAGE_WORDS", 1)
    check(df, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x1c ", max_size=30), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    w = words.Words(raw)
    want = [WORD.findall(t) for t in texts]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x.encode() for t in want for x in t]
    assert [w.data[a:b] for a, b in zip(w.start, w.end)] == flat
    hashes = {}
    for x, h in zip(flat, w.hash.tolist()):
        assert hashes.setdefault(x, h) == h
    assert len(set(hashes.values())) == len(hashes)
    h, at = w.windows(2)
    pairs = [p for t in want for p in zip(t, t[1:])]
    assert len(h) == len(pairs) and len(set(zip(pairs, h.tolist()))) == len(set(pairs)) == len(set(h.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=50))
def test_messages_round_trip(values):
    h = np.array(sorted(values), dtype=np.uint64)
    assert (S.decoded(S.encoded(h), len(h)) == h).all()


def test_changed_rows_are_noticed():
    import pyarrow as pa

    table = pa.table({"bucket": pa.array([0], pa.int32()), "part": pa.array([0], pa.int64()), "payload": pa.array([(1).to_bytes(8, "little") + S.encoded(np.array([5], np.uint64))])})
    with pytest.raises(ValueError, match="changed"):
        S.answered(S.answers(table), 2)


def test_a_text_and_its_copy_share_all_that_fits(spark):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))
    got = {r.doc_id: (r.longest_repeat, r.n_removed) for r in S.repeated_windows(spark.createDataFrame([(1, text), (2, text), (3, "alone")], "doc_id long, text string")).collect()}
    assert got == {1: (416, 0), 2: (416, 500), 3: (0, 0)}


def test_parts_are_bounded_in_bytes_and_follow_doc_id(spark, monkeypatch):
    """Long texts in one narrow range of ids, short ones far apart."""
    monkeypatch.setattr(S, "PART_WORDS", 5000)
    monkeypatch.setattr(S, "MESSAGE_WORDS", 1)
    rng = random.Random(7)
    rows = [(k, "word " * 900) for k in range(400)] + [(10**9 + 10**6 * k, "few words here") for k in range(2000)] + [(10**12 + rng.randrange(10**12), "word " * rng.randrange(200)) for _ in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = S.layout(docs)
    parts: dict = {}
    for r in S.dealt(docs, plan).collect():
        parts.setdefault(r.part, []).append((r.doc_id, len(r.text)))
    assert sum(map(len, parts.values())) == len(rows) and max(plan.cells)[0] < len(plan.cells)
    assert max(sum(n for _, n in p) for p in parts.values()) <= 2 * 5000 * S.WORD_BYTES
    order = sorted(parts)
    assert all(max(parts[a])[0] < min(parts[b])[0] for a, b in zip(order, order[1:]))
