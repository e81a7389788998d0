import itertools
import random

import numpy as np
import pytest

from voxframe.llm import crf, quality
from voxframe.llm.q_quality import op1_quality

from brute import base_counts


def test_query_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in op1_quality(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t)
        assert not (r.base_failed and r.kept)


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    rows = op1_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and (not bad or np.mean(bad) < 0.2)


def test_edge_cases(nasty, empty):
    model = quality.train(nasty.sparkSession, nasty, None)
    got = quality.judge(nasty, model).collect()
    assert len(got) == nasty.count()
    assert all(not r.kept and r.n_words == 0 for r in got if r.doc_id in (22, 23, 24))
    assert {r.n_words for r in got if r.doc_id == 25} == {1}
    kept = quality.keep(nasty, model)
    assert kept.columns == nasty.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(empty, model).count() == quality.keep(empty, model).count() == quality.label_lines(empty, model).count() == 0
    by_text = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got if r.doc_id is not None}
    for r in nasty.where("doc_id is not null").collect():
        assert by_text[r.doc_id] == base_counts(r.text)


def test_labels_with_nulls_and_no_labels(spark, nasty):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1), (5, 7)], "doc_id long, quality int")
    assert quality.judge(nasty, quality.train(spark, nasty, labels)).count() == nasty.count()
    assert quality.judge(nasty, quality.train(spark, nasty, labels.where("1 = 0"))).count() == nasty.count()


def test_line_labels_are_of_lines_with_words(spark):
    model = quality.train(spark, spark.createDataFrame([], "doc_id long, text string"), None)
    df = spark.createDataFrame([(1, "\n a b\n\n" + "c$$$ d### e*** f%%% " * 9 + "\n")], "doc_id long, text string")
    assert [r.line_no for r in quality.label_lines(df, model).orderBy("line_no").collect()] == [1, 3]


@pytest.mark.parametrize("seed", range(5))
def test_decoding_equals_trying_all_labellings(seed):
    rng = np.random.default_rng(seed)
    chain = crf.Chain(np.round(rng.normal(size=(4, 2)), 1), np.round(rng.normal(size=(2, 2)), 1), np.round(rng.normal(size=2), 1), np.zeros(3), np.ones(3))
    lengths = [3, 0, 1, 6]
    x = np.round(rng.normal(size=(sum(lengths), 3)), 1)
    got, at = chain.decode(x, np.array(lengths)), 0
    for n in lengths:
        e = chain.scores(x[at : at + n])
        value = lambda y: (chain.first[y[0]] + sum(e[k, y[k]] for k in range(n)) + sum(chain.step[a, b] for a, b in zip(y, y[1:]))) if n else 0  # noqa: B023, E731
        best = max(map(value, itertools.product((0, 1), repeat=n)))
        assert value(tuple(got[at : at + n])) == pytest.approx(best)
        at += n


def test_fitting_learns_emissions_and_transitions():
    rng = random.Random(0)
    y, x, lengths = [], [], []
    for _ in range(150):
        n, s = rng.randint(2, 12), rng.randint(0, 1)
        lengths.append(n)
        for _ in range(n):
            s = s if rng.random() < 0.9 else 1 - s
            y.append(s)
            x.append([s + rng.gauss(0, 0.8), rng.gauss(0, 1)])
    chain = crf.fit(np.array(x), np.array(y), lengths)
    assert chain.step[0, 0] + chain.step[1, 1] > chain.step[0, 1] + chain.step[1, 0]
    assert (chain.decode(np.array(x), np.array(lengths)) == np.array(y)).mean() > 0.85


def held_out(seed, n):
    """Documents of other makes than the built-in sample's: real words, menus and notices between paragraphs, with a label for
    each line."""
    rng = random.Random(seed)
    spell = lambda: "".join(rng.choice("bdfgklmprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    say = lambda: " ".join(spell() + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(8, 40))).capitalize() + "."
    junk = [
        lambda: " | ".join(["Home", "News", "Sports", "Weather", "Contact", "Login"][: rng.randint(4, 6)]),
        lambda: "BUY NOW!!! " * rng.randint(2, 5),
        lambda: "$$$ ### cheap*** " * rng.randint(2, 6),
        lambda: "click click click click here here here here " * 2,
    ]
    texts, labels = [], []
    for _ in range(n):
        lines, marks = [], []
        for _ in range(rng.randint(3, 6)):
            if rng.random() < 0.6:
                for _ in range(rng.randint(1, 3)):
                    lines.append(rng.choice(junk)())
                    marks.append(0)
            for _ in range(rng.randint(1, 4)):
                lines.append(say())
                marks.append(1)
        texts.append("\n".join(lines))
        labels.append(marks)
    return texts, labels


@pytest.mark.parametrize("labelled", [False, True])
def test_boilerplate_lines_in_good_documents_are_marked(spark, sf_dir, labelled):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(spark, docs, labels if labelled else None)
    texts, want = held_out(3, 120)
    got: dict = {}
    for r in quality.label_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        got[r.doc_id, r.line_no] = r.is_content
    pairs = [(got[d, k], bool(y)) for d, marks in enumerate(want) for k, y in enumerate(marks)]
    assert np.mean([g == y for g, y in pairs]) > 0.95
    assert np.mean([g for g, y in pairs if not y]) < 0.1 and np.mean([g for g, y in pairs if y]) > 0.95


def test_labels_change_inside_documents(spark, documents, sf_dir):
    model = quality.train(spark, documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kinds = quality.label_lines(documents, model).groupBy("doc_id").agg({"is_content": "max", "line_no": "count"}).count()
    both = quality.label_lines(documents, model).groupBy("doc_id").pivot("is_content", [True, False]).count().where("`true` > 0 and `false` > 0").count()
    print(f"{both} of {kinds} documents have lines of both labels")
    assert both >= 0.005 * kinds
    sample, marks = quality.built_in_sample()
    assert sum(len(set(m)) == 2 for m in marks) > 0.5 * len(marks)
