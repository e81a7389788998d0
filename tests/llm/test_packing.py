import functools
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import packing
from voxframe.llm.q_packing import op6_packing, vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows, docs, tokenizer, limit=2048):
    """rows of pack(); docs: [(doc_id, text)], repeats allowed."""
    want = []
    for d, t in docs:
        ids = ids_of(tokenizer, t)
        head = len(ids) % limit or limit
        cut = [0, *range(head, len(ids) + 1, limit)]
        want += [(str(d), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seats = {}
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit
    return len(seats), math.ceil(sum(w[3] for w in want) / limit)


def test_query_against_tokenizers(spark, sf_dir, texts, tokenizer):
    n, least = check(op6_packing(spark, sf_dir).collect(), list(texts.items()), tokenizer)
    assert n <= least + max(2, least // 50)


def test_edge_cases(nasty, empty, tokenizer):
    cut = packing.pieces(nasty, vocabulary())
    check(packing.pack(cut).collect(), [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()], tokenizer)
    assert packing.pack(packing.pieces(empty, vocabulary())).count() == 0
    short = packing.pieces(nasty, vocabulary(), 16)
    check(packing.pack(short, 16, blocks=3).collect(), [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()], tokenizer, 16)


def test_special_strings_are_as_the_library_says(spark, tokenizer):
    docs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|"), (3, "I'll it's 12 3.5\n\n  x"), (4, "a" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(packing.pack(packing.pieces(df, vocabulary())).collect(), docs, tokenizer)
    with_ids = packing.pieces(df, vocabulary(), with_ids=True).where("doc_id = 3").first().ids
    assert with_ids == ids_of(tokenizer, docs[2][1]).tolist()


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=25))
def test_plans_use_up_the_counts(counts):
    left = dict(counts)
    for lengths, times in packing.plan(counts, 40):
        assert times > 0 and sum(n * k for n, k in lengths) <= 40
        for n, k in lengths:
            left[n] -= k * times
    assert not any(left.values())


@pytest.mark.parametrize("seed", range(4))
def test_combinations_of_up_to_three_fill_gaps(seed):
    """Bins cut into one to four parts pack back into as many bins, or nearly."""
    rng, counts, bins = random.Random(seed), {}, 300
    for _ in range(bins):
        cuts = sorted(rng.sample(range(1, 2048), rng.randint(0, 3)))
        for a, b in zip([0, *cuts], [*cuts, 2048]):
            counts[b - a] = counts.get(b - a, 0) + 1
    assert sum(t for _, t in packing.plan(counts)) <= bins * 1.01 + 1


def test_exact_combination_is_found_and_counts_are_kept():
    left = np.zeros(101, dtype=int)
    left[[20, 30, 50]] = 1
    s = packing.Sums(left)
    assert s.exact(50, {}) == (50,) and sorted(s.exact(80, {})) == [30, 50] and sorted(s.exact(100, {})) == [20, 30, 50]
    assert s.exact(40, {}) is None and s.exact(50, {50: 1}) in ((30, 20), (20, 30)) and s.exact(100, {20: 1}) is None


def test_a_third_of_all_pieces_of_one_length(spark):
    df = spark.createDataFrame([(k, "" if k % 3 else "word " * (k % 90)) for k in range(3000)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(df, vocabulary(), 64), 64).collect()
    assert len(rows) >= 3000 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_tokenizers_library(text):
    """Any Unicode: the splitter's pattern and the merges give what the library gives."""
    text = text.encode("utf-8", "replace").decode("utf-8")
    assert packing.encoder(vocabulary())(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_ids_over_all_kinds_of_characters():
    rng = random.Random(12)
    kinds = [(9, 14), (32, 127), (0xA0, 0x250), (0x370, 0x530), (0x600, 0x700), (0x900, 0x980), (0x2000, 0x2070), (0x2150, 0x2190), (0x3040, 0x3100), (0x4E00, 0x4F00), (0x1F600, 0x1F650), (0xFE00, 0xFE10), (0x1D7CE, 0x1D800)]
    for _ in range(4000):
        text = "".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(30)))
        assert packing.encoder(vocabulary())(text).tolist() == library().encode(text, add_special_tokens=False).ids
