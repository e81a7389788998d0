import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.plans import annotate, cli
from voxframe.plans.steps import Registry, Report, Step, Store, Tasks, run_graph, summarize_run
from voxframe.sources import artifacts, audio, config
from voxframe.streaming import windows


def test_wav_round_trip_and_stereo_rule(spark, tmp_path):
    x = np.stack([np.sin(np.arange(1600) / 9) * 0.5, np.cos(np.arange(1600) / 7) * 0.25], 1)
    (tmp_path / "a.WAV").write_bytes(audio.encode_wav(x))
    f = audio.frames(audio.files(spark, str(tmp_path))).orderBy("frame").collect()
    assert len(f) == 10 and np.allclose(np.concatenate([r.left for r in f]), x[:, 0], atol=1e-4)
    (tmp_path / "mono").mkdir()
    (tmp_path / "mono" / "b.wav").write_bytes(audio.encode_wav(x[:, 0]))
    with pytest.raises(Exception, match="requires stereo"):
        audio.frames(audio.files(spark, str(tmp_path / "mono"))).count()
    assert audio.frames(audio.files(spark, str(tmp_path / "mono")), channels=None).count() == 10


def test_stress_recording(spark):
    s = audio.stress_samples(spark)
    assert s.count() == 7 * 8000 and s.where("state = 'SIL'").agg(F.max(F.abs("left"))).first()[0] == 0
    assert audio.stress_reference(spark, "r").groupBy("state").count().where("state = 'LEAK'").first()["count"] == 50


def test_annotation_end_to_end(spark, tmp_path):
    t = np.arange(8000) / 16000
    tone = 0.06 * np.sin(2 * np.pi * 200 * t)
    x = np.stack([np.concatenate([tone, tone * 0, tone * 0]), np.concatenate([tone * 0, tone * 0, tone])], 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "two.wav").write_bytes(audio.encode_wav(x))
    a = annotate.annotate_files(spark, str(tmp_path / "in"))
    labels = {r.label for r in a.segments.collect()}
    assert {"A", "B"} <= labels
    annotate.write_run(a, tmp_path / "out")
    assert artifacts.read(spark, "states", f"{tmp_path}/out/states").count() == 1
    with pytest.raises(Exception, match="expected an artifact"):
        artifacts.read(spark, "ipus", f"{tmp_path}/out/states").count()
    said = annotate.transcribe(a, a.path.groupBy("rec").agg((F.count("*") * 0.01).alias("duration_s")), lambda: lambda c: [(0.0, 0.2, "hello")])
    assert {r.text for r in said.collect()} == {"hello"}


def test_typed_json_orders_words(spark, tmp_path):
    df = spark.sql("select 'r' as rec, 'en' as language, array(named_struct('text', 'b', 'start', 2d, 'end', 3d, 'speaker', cast(null as string), 'confidence', cast(null as double)), named_struct('text', 'a', 'start', 1d, 'end', 2d, 'speaker', 'A', 'confidence', 0.5d)) as words")
    artifacts.write(df, "transcript", str(tmp_path / "t"))
    assert [w.text for w in artifacts.read(spark, "transcript", str(tmp_path / "t")).first().words] == ["a", "b"]
    with pytest.raises(ValueError):
        artifacts.write(df, "other", str(tmp_path / "t"))


def test_scorecard_and_tracks_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("b", "hard", "ok", 0.5), ("a", "easy", "ok", 0.25)], "id string, tier string, status string, boundary_f1_20ms double")
    artifacts.write_scorecard(rows, str(tmp_path / "s"), {"k": "v"})
    assert [r.id for r in artifacts.read_scorecard(spark, str(tmp_path / "s")).orderBy("tier").collect()] == ["a", "b"]
    frames = spark.createDataFrame([(1, "vad", 0, 0.5), (1, "leak", 0, 0.1)], "rec long, track string, frame long, value double")
    artifacts.write_tracks(frames, str(tmp_path / "t"))
    assert artifacts.read_tracks(spark, str(tmp_path / "t"), ("vad",)).count() == 1


def test_config(tmp_path):
    (tmp_path / "config.yaml").write_text("name: 'x' # note\npaths:\n  out_dir: runs\nodd line\n")
    c = config.load(tmp_path)
    assert c == {"name": "x", "paths": {"out_dir": "runs"}} and str(config.out_dir(c)) == "runs" and str(config.out_dir(c, "o")) == "o"
    with pytest.raises(config.ConfigError):
        config.out_dir({})
    got = config.RunConfig(prefix="P_").from_env({"P_ERROR_MODE": "debug", "P_MAX_FAILURES": "x", "P_WRITE_JSONL": "0"})
    assert (got.mode, got.max_failures, got.write_events) == ("debug", None, False)


def quiet(**k):
    return Report(config.RunConfig(write_events=False, **k))


def test_tasks_skip_what_depends_on_a_failure():
    t, ran = Tasks(r := quiet()), []
    t.add("a", lambda: 1 / 0)
    t.add("b", lambda: ran.append("b"), ["a"])
    t.add("c", lambda: ran.append("c"))
    assert t.run() == {"c": None} and ran == ["c"]
    assert [r.status(s) for s in "abc"] == ["FAILED", "SKIPPED", "OK"] and r.exit_code == 1 and "ZeroDivisionError" in r.summary()
    with pytest.raises(ValueError):
        t.add("a", lambda: 0)


def test_tasks_limits_and_cycles(tmp_path):
    t = Tasks(r := quiet(max_failures=1))
    for n in "abc":
        t.add(n, lambda: 1 / 0)
    t.run()
    assert [r.status(s) for s in "abc"] == ["FAILED", "SKIPPED", "SKIPPED"]
    t = Tasks(quiet())
    t.add("a", lambda: 0, ["b"])
    t.add("b", lambda: 0, ["a"])
    with pytest.raises(RuntimeError):
        t.run()
    t = Tasks(r := quiet(mode="debug"))
    t.add("a", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.run()
    r = Report(config.RunConfig(log_dir=tmp_path))
    with r.guard("x"):
        raise KeyError("k")
    assert json.loads((tmp_path / f"events_{r.run_id}.jsonl").read_text())["event"] == "step_failed"


def graph():
    g, runs = Registry(), []

    def step(name, inputs, f):
        def run(state):
            runs.append(name)
            return {name: f(state)}

        g.register(Step(name, inputs, (name,), run))

    step("words", ("audio",), lambda s: s["audio"] + " words")
    step("table", ("words",), lambda s: s["spark"].range(3) if "spark" in s else [1, 2])
    step("end", ("words", "table"), lambda s: len(s["table"]))
    return g, runs


def test_graph_order_cache_and_records(spark, tmp_path):
    g, runs = graph()
    assert [s.name for s in g.order({"audio"}, ("end",))] == ["words", "table", "end"]
    assert [s.name for s in g.order({"words"}, ("table",))] == ["table"]
    store = Store(spark, tmp_path)
    assert run_graph(g, store, {"audio": "a"}, ("end",), "r1")["end"] == 2 and len(runs) == 3
    assert run_graph(g, store, {"audio": "a"}, ("end",), "r2")["end"] == 2 and len(runs) == 3
    assert summarize_run(tmp_path, "r2")["steps_executed"] == ["words", "table", "end"]
    with pytest.raises(ValueError, match="no step"):
        g.order(set(), ("end",))
    with pytest.raises(ValueError, match="registered"):
        g.register(Step("words", (), ("x",), lambda s: {}))
    g.register(Step("loop1", ("loop2",), ("loop1",), lambda s: {}))
    g.register(Step("loop2", ("loop1",), ("loop2",), lambda s: {}))
    with pytest.raises(ValueError, match="itself"):
        g.order(set(), ("loop1",))
    g.register(Step("short", (), ("long",), lambda s: {}))
    with pytest.raises(ValueError, match="did not make"):
        run_graph(g, store, {}, ("long",), "r3")
    assert summarize_run(tmp_path, "r3")["failures"][0]["step"] == "short"
    g.register(Step("frame", (), ("frame",), lambda s: {"frame": spark.range(5)}))
    assert run_graph(g, store, {}, ("frame",))["frame"].count() == run_graph(g, store, {}, ("frame",))["frame"].count() == 5


def test_command_line_parses():
    a = cli.parser().parse_args(["run", "in", "--out", "o", "--high-recall"])
    assert a.command == "run" and cli._tuning(a).high_recall


def test_streaming_sessions_and_frames(spark, tmp_path):
    rows = [("r", "A", f"2024-01-01 00:00:0{s}", 0.5) for s in ("0.00", "0.10", "0.30", "2.00", "2.10")]
    df = spark.createDataFrame(rows, "rec string, label string, t string, value double").select("rec", "label", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, build in (("sessions", windows.sessions), ("framed", windows.framed), ("smoothed", windows.smoothed)):
        q = build(stream).writeStream.format("memory").queryName(f"s_{name}").outputMode("complete" if name != "sessions" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select count(*) from s_framed").first()[0] == 5
    assert windows.sessions(df).count() == 2
    assert time.time() > 0


def test_default_graph(spark, tmp_path):
    t = np.arange(8000) / 16000
    tone = 0.06 * np.sin(2 * np.pi * 200 * t)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "two.wav").write_bytes(audio.encode_wav(np.stack([np.concatenate([tone, tone * 0]), np.concatenate([tone * 0, tone])], 1)))
    graph = annotate.steps(lambda: lambda c: [(0.0, 0.1, "hi")])
    assert [s.name for s in graph.order({"frames"}, ("diagnostics", "alignment"))] == ["evidence", "decode", "diagnostics", "transcription", "alignment"]
    assert [s.name for s in graph.order({"transcript", "segments"}, ("alignment",))] == ["alignment"]
    frames = audio.frames(audio.files(spark, str(tmp_path / "in")))
    out = run_graph(graph, Store(spark, tmp_path / "store"), {"frames": frames}, ("diagnostics", "alignment"))
    assert out["diagnostics"].count() == 1 and {w for r in out["alignment"].collect() for w in r.text.split()} == {"hi"}


def test_named_suite(spark):
    from voxframe.operators import evaluation

    assert evaluation.named_suite(spark, " Week1 ").count() == 1 and evaluation.named_suite(spark, "week1", ("hard", "easy")).count() == 0
    with pytest.raises(ValueError):
        evaluation.named_suite(spark, "other")


def test_voice_activity_with_or_without_the_detector(spark):
    from voxframe.operators import vad

    rows = [("r", i, [0.0] * 160 if i < 20 else (0.1 * np.sin(np.arange(160) / 5)).tolist()) for i in range(40)]
    got = [r.vad for r in vad.soft_vad(spark.createDataFrame(rows, "rec string, frame long, samples array<double>")).orderBy("frame").collect()]
    assert len(got) == 40 and min(got) >= 0 and max(got) <= 1 and got[35] > got[3]
    assert len(vad.sixteen_bit(np.ones(80), 160)) == 320
