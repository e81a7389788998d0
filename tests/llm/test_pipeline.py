"""The pipeline against plain versions of each stage's rule, on each stage's own input."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from voxframe.llm import linededup, mixing, quality
from voxframe.llm.q_packing import vocabulary
from voxframe.llm.scratch import stored

from brute import WORD, base_counts, near_components


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    docs = []
    block = [say(12) for _ in range(30)]
    for k in range(60):
        lines = [say(rng.randint(10, 40)) for _ in range(rng.randint(2, 8))]
        if k % 9 == 0:
            lines[1:1] = block
        docs.append((k, "\n".join(lines)))
    docs += [(100 + k, docs[k][1].replace("a", "a", 1) + " end") for k in range(6)]
    docs += [(200, "short"), (201, None), (202, ""), (203, "spam spam spam " * 60), (204, " ".join(f"w{i}###" for i in range(300)))]
    path = tmp_path_factory.mktemp("pipeline")
    df = spark.createDataFrame([(d, t, "en", f"src{d % 4}", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 200), 0) for d, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], sample), "test"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_shape_of_the_stages(stages):
    assert [s[0] for s in P.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality_stage(spark, sample, stages):
    before, after = texts(stages[0]), texts(stages[1])
    model = quality.train(spark, stages[0], spark.read.parquet(f"{sample}/labels.parquet"))
    kept = {r.doc_id: r.kept for r in quality.judge(stages[0], model).collect()}
    assert after == {d: t for d, t in before.items() if kept[d]}
    assert all(d not in after for d, t in before.items() if base_counts(t)[5]) and 204 not in after
    assert all(d in after for d in before if d < 200 and not base_counts(before[d])[5])


def test_line_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert before.keys() == after.keys()
    parts = {r.doc_id: [(c.text, c.lines) for c in r.c] for r in stages[1].select("doc_id", linededup.chunks(F.col("text")).alias("c")).collect()}
    seen, want = set(), {}
    for d in sorted(parts):
        left = []
        for text, lines in parts[d]:
            if lines < 2 or text not in seen:
                left.append(text)
            if lines >= 2:
                seen.add(text)
        want[d] = "\n".join(left)
    assert after == want and any(after[d] != before[d] for d in after)
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    comp, _ = near_components(before, 5)
    assert after == {d: t for d, t in before.items() if comp[d] == d}


def test_mixing_stage(stages):
    before, after = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    assert all(n <= 3 for n in after.values()) and after.keys() <= {r.doc_id for r in before}
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    source = {r.doc_id: r.source for r in before}
    target = {r.source: r.target for r in mixing.mix(mixing.sized(stages[3])).collect()}
    for s, t in target.items():
        taken = sum(size[d] * n for d, n in after.items() if source[d] == s)
        assert abs(taken - t) <= max(size[d] for d in size if source[d] == s)
    assert {r.doc_id: (r.text, r.lang, r.source) for r in stages[4].collect()} == {r.doc_id: (r.text, r.lang, r.source) for r in before if r.doc_id in after}


def test_packing_stage_and_run(spark, sample, stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    import numpy as np

    want = Counter()
    for r in stages[4].collect():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        head = len(ids) % 2048 or 2048
        edges = [0, *range(head, len(ids) + 1, 2048)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    rows = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(stages[5]) == want
    assert rows(P.run(spark, sample)) == want


def test_edge_cases_in_each_stage(spark, sample, nasty, empty):
    for name, stage in P.STAGES:
        for df in (nasty, empty):
            out = stage(spark, df, sample)
            n = out.count()
            assert n == 0 if df is empty else True
            if name != "packing":
                assert out.columns == df.columns


def test_run_removes_what_its_stages_stored(spark, sample):
    from pathlib import Path

    from voxframe.llm.scratch import root

    at = Path(root(spark).removeprefix("file:")) / "tables"
    before = {p.name for p in at.iterdir()} if at.exists() else set()
    n = P.run(spark, sample).count()
    left = sorted(p.name.rsplit("-", 1)[0] for p in at.iterdir() if p.name not in before)
    assert n > 0 and left == ["mixing", "pack-pieces"]
