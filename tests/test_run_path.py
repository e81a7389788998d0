"""From recordings, suites and files of other tools to artifacts, through the command line and its parts."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import fusion, recognisers, textgrid
from voxframe.plans import annotate, cli, logs
from voxframe.sources import artifacts, audio, config, npz, references


@pytest.fixture(autouse=True)
def quiet_logs(monkeypatch, tmp_path):
    monkeypatch.setenv("VOXFRAME_LOG_DIR", str(tmp_path / "logs"))


@pytest.fixture
def recordings(tmp_path):
    t = np.arange(8000) / 16000
    tone = 0.06 * np.sin(2 * np.pi * 200 * t)
    x = np.stack([np.concatenate([tone, tone * 0, tone * 0]), np.concatenate([tone * 0, tone * 0, tone])], 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "two.wAv").write_bytes(audio.encode_wav(x))
    return tmp_path / "in"


def test_run_writes_all_artifacts_to_a_uri(spark, recordings, tmp_path):
    out = f"file://{tmp_path}/out"
    assert cli.main(["run", str(recordings), "--out", out, "--asr", "voxframe.operators.recognisers:echo", "--run-id", "r1", "--leakage"]) == 0
    made = tmp_path / "out"
    assert {p.name for p in made.iterdir()} >= {"evidence", "path", "states", "ipus", "diagnostics", "textgrids", "transcript", "alignment", "transcript_textgrids", "annotation_textgrids", "metadata.json"}
    about = json.loads((made / "metadata.json").read_text())
    assert about["run_id"] == "r1" and about["pipeline_steps"][-1] == "alignment"
    words = artifacts.read(spark, "transcript", f"{out}/transcript").first().words
    assert {(w.text, w.speaker) for w in words} == {("A0", "A"), ("B1", "B")}
    document = spark.read.parquet(f"{out}/transcript_textgrids").first().document
    assert 'name = "segments_A"' in document and 'name = "words_B"' in document and document.index("words_A") < document.index("segments_B")
    document = spark.read.parquet(f"{out}/annotation_textgrids").first().document
    assert [document.index(f'name = "{t}"') for t in textgrid.ANNOTATION_TIERS] == sorted(document.index(f'name = "{t}"') for t in textgrid.ANNOTATION_TIERS)
    assert "leakage_likelihood" in spark.read.parquet(f"{out}/evidence").columns
    log = (tmp_path / "logs" / "run_r1.log").read_text()
    assert "run=r1" in log and "step=run" in log and (tmp_path / "logs" / "events_r1.jsonl").exists()


def test_decoding_starts_from_what_is_stored(spark, recordings, tmp_path):
    done = annotate.annotate_files(spark, str(recordings), keep=annotate.kept(f"{tmp_path}/out"))
    assert done.path.inputFiles() and all("/out/path/" in f for f in done.path.inputFiles())
    assert all("/out/" in f for df in (done.segments, done.diagnostics) for f in df.inputFiles())


def test_suite_to_leaderboard(spark, tmp_path):
    base, out = f"{tmp_path}/base", f"{tmp_path}/tuned"
    assert cli.main(["eval", "--suite", "week1", "--out", base, "--run-id", "e"]) == 0
    card = json.loads((tmp_path / "base" / "scorecard.json").read_text())
    assert [r["id"] for r in card["results"]] == ["synthetic_leakage"] and card["results"][0]["status"] == "ok" and set(card["by_tier"]) == {"synthetic"}
    assert (tmp_path / "base" / "_synthetic" / "synthetic_leakage.wav").exists()
    assert cli.main(["tune", "--suite", "week1", "--baseline", base, "--out", out]) == 0
    board = json.loads((tmp_path / "tuned" / "leaderboard.json").read_text())
    assert sorted(r["candidate"] for r in board) == [0, 1, 2, 3] and [r["place"] for r in board] == [1, 2, 3, 4]
    delta = json.loads((tmp_path / "tuned" / "0" / "delta.json").read_text())
    assert len(delta["baseline"]["sha1"]) == 40 and not delta["failed"] and delta["rows"][0]["boundary_f1_20ms_delta"] == 0
    assert len((tmp_path / "tuned" / "leaderboard.csv").read_text().splitlines()) == 5
    assert artifacts.read_scorecard(spark, f"{base}/scorecard.json").count() == artifacts.read_scorecard(spark, base).count() == 1


def test_manifest_with_references_of_every_kind(spark, recordings, tmp_path):
    wav = str(recordings / "two.wAv")
    states = ["A"] * 50 + ["SIL"] * 50 + ["B"] * 40 + ["SIL"] * 10
    (tmp_path / "a.json").write_text(json.dumps(states))
    (tmp_path / "b.npy").write_bytes(references.write_npy(states))
    held = io.BytesIO()
    np.save(held, np.array(states, dtype=object), allow_pickle=True)
    (tmp_path / "c.NPY").write_bytes(held.getvalue())
    grid = spark.createDataFrame([("x", "SpeakerA", 0.0, 0.5, "A"), ("x", "SpeakerB", 1.0, 1.4, "B")], "rec string, tier string, start_time double, end_time double, label string")
    (tmp_path / "d.TextGrid").write_text(textgrid.render(grid).first().document)
    rows = [{"id": k, "tier": "easy", "audio_path": wav, "ref_path": str(tmp_path / f)} for k, f in (("a", "a.json"), ("b", "b.npy"), ("c", "c.NPY"), ("d", "d.TextGrid"))]
    rows += [{"id": "self", "tier": "hard", "audio_path": wav}, {"id": "lost", "tier": "hard", "audio_path": str(tmp_path / "none.wav")}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    assert cli.main(["eval", "--manifest", str(tmp_path / "m.json"), "--out", f"{tmp_path}/out"]) == 0
    card = {r["id"]: r for r in json.loads((tmp_path / "out" / "scorecard.json").read_text())["results"]}
    assert card["a"]["iou_any"] == card["b"]["iou_any"] == card["c"]["iou_any"] == pytest.approx(card["d"]["iou_any"], abs=0.02)
    assert card["self"]["iou_any"] == 1 and card["lost"]["status"] == "failed" and card["a"]["iou_any"] > 0.7
    with pytest.raises(ValueError, match="unsupported"):
        references.load(spark.createDataFrame([("x", "r.txt")], "rec string, ref_path string"), spark.createDataFrame([("x", 3)], "rec string, n_frames long"))


def test_arrays_of_objects_cannot_call(tmp_path):
    class Bad:
        def __reduce__(self):
            return (print, ("called",))

    held = io.BytesIO()
    np.save(held, np.array([Bad()], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="not allowed"):
        references.read_npy(held.getvalue())


def test_track_archives_and_bundles(spark, tmp_path):
    folder = tmp_path / "r1"
    folder.mkdir()
    content, about = npz.archive("vad", np.array([0.1, 0.9]), "probability", 0.01, np.array([1.0, 0.5]))
    (folder / "vad.npz").write_bytes(content)
    np.savez(folder / "all.npz", energy=np.array([1.0, 2.0, 3.0]), frame_hop=np.array(0.01), duration=np.array(0.03))
    got = npz.read(spark, str(tmp_path)).orderBy("track", "frame").collect()
    assert [(r.track, r.value, r.confidence) for r in got] == [("energy", 1.0, None), ("energy", 2.0, None), ("energy", 3.0, None), ("vad", 0.1, 1.0), ("vad", 0.9, 0.5)]
    (folder / "manifest.json").write_text(json.dumps({"timebase": {"hop_s": 0.01, "n_frames": 2}, "tracks": {"vad": about | {"file": "vad.npz"}}}))
    assert [(r.track, r.semantics, r.value) for r in npz.read_bundle(spark, str(folder)).orderBy("frame").collect()] == [("vad", "probability", 0.1), ("vad", "probability", 0.9)]
    rows = npz.write_bundles(spark.createDataFrame([("r", "vad", k, 0.5) for k in range(3)], "rec string, track string, frame long, value double"), f"{tmp_path}/files", 0.01)
    (tmp_path / "back").mkdir()
    for r in rows.collect():
        (tmp_path / "back" / r.file).write_bytes(r.content)
    assert npz.read_bundle(spark, str(tmp_path / "back")).count() == 3


def test_evidence_cache_computes_new_files_only(spark, recordings, tmp_path, monkeypatch):
    calls = []
    plain = annotate.evidence
    monkeypatch.setattr(annotate, "evidence", lambda *a, **k: calls.append(1) or plain(*a, **k))
    count = lambda: annotate.cached_evidence(spark, str(recordings), f"{tmp_path}/cache").select("rec").distinct().count()
    assert count() == count() == 1 and len(calls) == 1
    (recordings / "again.wav").write_bytes((recordings / "two.wAv").read_bytes())
    assert count() == 2 and len(calls) == 2
    assert spark.read.parquet(f"{tmp_path}/cache/evidence").groupBy("rec").count().select("count").distinct().count() == 1


def test_inspection_tracks(spark, recordings):
    out = annotate.evidence(audio.frames(audio.files(spark, str(recordings))), with_leakage=True, inspect=True)
    assert set(out.columns) >= {"energy_rms", "energy_smooth", "energy_slope", "voiced_soft", "log_ratio", "correlation", "overlap_proxy", "leakage_likelihood"}
    assert out.where("voiced_soft != vad").count() == 0 and out.count() == 150


def test_tracks_must_share_a_grid(spark):
    rows = [("r", t, k, 0.5) for t in ("vad", "diar_a", "diar_b") for k in range(10)]
    df = spark.createDataFrame(rows, "rec string, track string, frame long, value double")
    assert fusion.fuse_tracks(df).count() == 10
    with pytest.raises(ValueError, match="differ in frames"):
        fusion.fuse_tracks(df.where("not (track = 'vad' and frame = 9)"))
    with pytest.raises(ValueError, match="no tracks"):
        fusion.fuse_tracks(df.where("track = 'x'"))


def test_transcript_documents(spark):
    seg = spark.createDataFrame([("r", "A", 0.0, 1.0, "one"), ("r", "A", 0.5, 1.5, "two"), ("r", "A", 2.0, 2.0, "none"), ("q", None, 0.0, 1.0, "x")], "rec string, speaker string, start_time double, end_time double, text string")
    words = spark.createDataFrame([("r", "A", 0.0, 0.4, "w")], "rec string, speaker string, start_time double, end_time double, word string")
    docs = {r.rec: r.document for r in textgrid.transcript_document(seg, words).collect()}
    assert 'name = "segments_A"' in docs["r"] and 'name = "words_A"' in docs["r"] and "size = 2" in docs["r"]
    assert 'xmin = 1\n            xmax = 1.5\n            text = "two"' in docs["r"] and "none" not in docs["r"]
    assert 'name = "segments"' in docs["q"] and 'name = "words"' in docs["q"]
    with pytest.raises(ValueError):
        textgrid.annotation_document(other=seg)


def test_textgrid_files(spark, tmp_path):
    df = spark.createDataFrame([("r", "SpeakerA", 0.25, 1.5, "A"), ("q", "Leak", 0.0, 0.5, "LEAK")], "rec string, tier string, start_time double, end_time double, label string")
    artifacts.write_textgrids(textgrid.render(df), f"{tmp_path}/t")
    got = artifacts.read_textgrids(spark, f"{tmp_path}/t")
    assert sorted((r.tier, r.start_time, r.end_time, r.label) for r in got.collect()) == [("Leak", 0.0, 0.5, "LEAK"), ("SpeakerA", 0.25, 1.5, "A")]


def test_recognisers(tmp_path, monkeypatch):
    assert recognisers.named("voxframe.operators.recognisers:echo")()({"label": "A", "channel": 0, "start_time": 0.0, "end_time": 1.0})[0] == (0.0, 1.0, "A0")
    with pytest.raises(ValueError):
        recognisers.named("fake")
    model = recognisers.Whisper("base", model_dir=str(tmp_path))
    assert model.status()["exists"] == "no" and str(tmp_path) in model.status()["next_step"]
    assert len(recognisers.to_rate(np.zeros(800), 8000)) == 1600 and len(recognisers.stretch(np.zeros(100), 10, 2.0, 99.0)) == 80
    with pytest.raises(ValueError):
        recognisers.to_rate(np.zeros(3), 0)
    assert cli.main(["asr-setup", "--asr-model-dir", str(tmp_path)]) == 0


def test_logging_is_replaced_by_a_second_call(tmp_path):
    settings = config.RunConfig(log_dir=tmp_path)
    logs.configure(settings, "one")
    log = logs.configure(settings, "two")
    log.info("hello")
    assert len(log.handlers) == 2 and "hello" in (tmp_path / "run_two.log").read_text() and "hello" not in (tmp_path / "run_one.log").read_text()


def test_synthetic_scores(spark):
    from voxframe.operators import decode as dec

    s = audio.scripted_scores(spark, "r", [("A", 6), ("SIL", 5), ("B", 6)])
    assert [r.state for r in dec.decode(s).orderBy("frame").collect()][3::6] == ["A", "SIL", "B"]
    a = audio.seeded_scores(spark, "r", 2000, 7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, audio.seeded_scores(spark, "r", 2000, 7).repartition(3).collect()))
    assert abs(a.agg(F.avg("s_a")).first()[0]) < 0.1 and abs(a.agg(F.stddev("s_b")).first()[0] - 1) < 0.1
    assert audio.regions([2, 3]) == [(0, 2), (2, 5)]
    assert [r.value for r in audio.diar_track(spark, "r", [("A", 1), ("B", 1)], "A").orderBy("frame").collect()] == [0.9, 0.1]
    assert [r.value for r in audio.leak_track(spark, "r", [("LEAK", 1), ("B", 1)]).orderBy("frame").collect()] == [0.7, 0.05]
