"""Memory of decoding, identities of inputs, and stores on file systems named by URI."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from voxframe.operators import decode as dec
from voxframe.operators import transcript
from voxframe.plans.steps import Registry, Step, Store, run_graph, summarize_run
from voxframe.sources import files

ROOT = str(Path(__file__).resolve().parents[1])


def test_many_short_recordings_and_a_long_one_need_no_padding():
    """10,000 recordings of 10 frames and one of 100,000 in one batch, in a process of its own."""
    code = """
import resource; import numpy as np
from voxframe.operators import decode as dec
rng = np.random.default_rng(0)
many = [rng.normal(size=(10, 5)) for _ in range(10_000)] + [rng.normal(size=(100_000, 5))]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = dec.viterbi(many, dec.model())
assert [len(p) for p in out] == [len(x) for x in many]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT}, check=True)
    assert int(done.stdout) < 500


def test_empty_recordings_and_empty_lists():
    assert dec.viterbi([], dec.model()) == []
    assert [len(p) for p in dec.viterbi([np.zeros((0, 5)), np.zeros((2, 5))], dec.model())] == [0, 2]


def test_rows_without_a_recording_are_one_recording(spark):
    rng = np.random.default_rng(1)
    rows = [(rec, i, *rng.normal(size=5).tolist()) for rec in (None, 2**60 + 1, 2**60 + 2) for i in range(20)]
    df = spark.createDataFrame(rows, "rec long, frame long, s_sil double, s_a double, s_b double, s_ovl double, s_leak double")
    got = dec.decode(df).collect()
    assert sorted((str(r.rec), r.frame) for r in got) == sorted((str(r[0]), r[1]) for r in rows)
    null = [r.state for r in sorted((r for r in got if r.rec is None), key=lambda r: r.frame)]
    assert null == [dec.STATES[k] for k in dec.viterbi([np.array([r[2:] for r in rows if r[0] is None])], dec.model())[0]]


def test_all_candidates_in_one_pass(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(rec, i, *rng.normal(size=5).tolist()) for rec in range(5) for i in range(60)], "rec long, frame long, s_sil double, s_a double, s_b double, s_ovl double, s_leak double")
    both = dec.decode_all(df, {k: dec.model(t) for k, t in enumerate(dec.GRID)})
    for k, t in enumerate(dec.GRID):
        assert sorted(map(tuple, both.where(f"candidate = {k}").drop("candidate").collect())) == sorted(map(tuple, dec.decode(df, t).collect()))


def test_repeats_are_compared_with_the_last_kept_segment(spark):
    drift = [(1, 0.6e-6 * k, 1.0, "a") for k in range(6)] + [(1, 5.0, 6.0, "a"), (1, 5.0, 6.0, "b"), (1, 7.0, 8.0, " "), (None, 0.0, 1.0, "a"), (None, 0.0, 1.0, "a")]
    df = spark.createDataFrame(drift, "rec long, start_time double, end_time double, text string")
    want, last = [], {}
    for r in sorted(drift, key=lambda r: (str(r[0]), *r[1:])):
        k = last.get(r[0])
        if r[3].strip() and not (k and abs(r[1] - k[1]) < 1e-6 and abs(r[2] - k[2]) < 1e-6 and r[3] == k[3]):
            last[r[0]] = r
            want.append(r)
    got = transcript.merge_adjacent(df)
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 6


def graph(runs):
    g = Registry()

    def run(state):
        runs.append(1)
        return {"n": state["table"].count()}

    g.register(Step("count", ("table",), ("n",), run))
    return g


def test_a_rewritten_input_is_not_served_from_the_store(spark, tmp_path):
    runs, root = [], f"file://{tmp_path}/store"
    store = Store(spark, root)
    out = lambda: run_graph(graph(runs), store, {"table": spark.read.parquet(f"file://{tmp_path}/in")}, ("n",), "r")["n"]
    spark.range(5).write.parquet(f"file://{tmp_path}/in")
    assert out() == out() == 5 and len(runs) == 1
    spark.range(7).write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    assert out() == 7 and len(runs) == 2 and summarize_run(root, "r", spark)["steps_executed"] == ["count"]
    assert (tmp_path / "store" / "runs" / "r" / "step_logs.json").exists()


def test_every_file_of_a_table_counts(spark, tmp_path):
    """1200 files: a change of the last one changes the identity."""
    for k in range(1200):
        (tmp_path / f"{k:05}.txt").write_text("x")
    paths = [f"file://{tmp_path}/{k:05}.txt" for k in range(1200)]
    before = files.identities(spark, paths)
    (tmp_path / "01199.txt").write_text("xyz")
    after = files.identities(spark, paths)
    assert len(before) == 1200 and before != after and before[:-1] == after[:-1]


def test_text_on_a_file_system(spark, tmp_path):
    files.write_text(spark, f"file://{tmp_path}/a/b.txt", "é\n")
    assert files.read_text(spark, f"file://{tmp_path}/a/b.txt") == "é\n" and not files.exists(spark, f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="none"):
        files.read_text(spark, f"file://{tmp_path}/none")
