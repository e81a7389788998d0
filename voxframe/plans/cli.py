"""Command line: run, evidence, decode, eval, tune, asr-setup."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators import decode, evaluation, fusion, recognisers, segments
from voxframe.plans import annotate, logs
from voxframe.plans.steps import VERSION, Report, Tasks, new_run_id
from voxframe.sources import artifacts, audio, config, files, references

SCENARIO = "leakage_stress"


def session() -> SparkSession:
    return SparkSession.builder.appName("voxframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _tuning(args: argparse.Namespace) -> decode.Tuning:
    return decode.Tuning(args.speaker_switch, args.leak_entry, args.overlap, high_recall=args.high_recall, silence_bias=args.silence_bias)


def _out(args: argparse.Namespace) -> str:
    return config.out_dir(config.load("."), args.out).rstrip("/")


def _backend(args: argparse.Namespace):
    whisper = recognisers.Whisper(args.asr_model, args.asr_model_path, args.asr_model_dir, args.language)
    return whisper if args.asr == "whisper" else recognisers.named(args.asr)


def run(args: argparse.Namespace) -> None:
    """Everything from a folder of recordings to artifacts, with a transcript if a recogniser is named."""
    spark, out = session(), _out(args)
    done = annotate.annotate_files(spark, args.path, _tuning(args), keep=annotate.kept(out), with_leakage=args.leakage)
    annotate.write_run(done, out)
    if args.asr:
        annotate.write_transcript(done, annotate.recognise(done.segments, annotate.lengths_of(done.path), _backend(args)), out)
    steps = ["evidence", "decode", "diagnostics", *(["transcription", "alignment"] if args.asr else [])]
    artifacts.write_run_metadata(spark, out, args.run_id, args.path, steps, VERSION)


def evidence(args: argparse.Namespace) -> None:
    """Tracks alone, with those that decoding does not use; with a cache, only of recordings that it lacks."""
    spark, out = session(), _out(args)
    if args.cache:
        found = annotate.cached_evidence(spark, args.path, args.cache, with_leakage=True)
    else:
        found = annotate.evidence(audio.frames(audio.files(spark, args.path)), with_leakage=True, inspect=True)
    found.write.mode("overwrite").parquet(f"{out}/evidence")


def decode_tracks(args: argparse.Namespace) -> None:
    """State path and segments of stored tracks, wide or long; long ones must share a grid."""
    out, tuning = _out(args), _tuning(args)
    tracks = session().read.parquet(args.path)
    scores = fusion.fuse_tracks(tracks, tuning) if "track" in tracks.columns else fusion.fuse(tracks, tuning)
    path = annotate.kept(out)(decode.decode(scores, tuning), "path")
    segments.merge_per_label(segments.ipus(path), tuning.merge_gap_ms / 1000).write.mode("overwrite").parquet(f"{out}/segments")


def items_of(spark: SparkSession, args: argparse.Namespace, out: str) -> DataFrame:
    """The items (id, tier, scenario, audio_path, ref_path) of the suite or manifest that is asked for. Synthetic ones without
    a recording get theirs written below out; one whose files are missing keeps no recording, and so fails."""
    if args.suite:
        found = evaluation.named_suite(spark, args.suite, tuple(args.segments or ())).withColumn("audio_path", F.lit(None).cast("string")).withColumn("ref_path", F.lit(None).cast("string"))
    elif args.manifest:
        found = evaluation.suite(artifacts.read_manifest(spark, args.manifest), tuple(args.segments or ()))
    else:
        raise config.ConfigError("a manifest or a suite is needed")
    rows = []
    for r in found.select("id", "tier", "scenario", "audio_path", "ref_path").collect():  # a manifest's lines
        wav, ref = r.audio_path, r.ref_path
        if r.tier == "synthetic" and wav is None:
            if (r.scenario or "").strip() != SCENARIO:
                raise ValueError(f"unknown scenario {r.scenario!r}")
            wav, ref = audio.stress_files(spark, r.id, f"{out}/_synthetic")
        whole = all(p is None or files.exists(spark, p) for p in (wav, ref))
        rows.append((r.id, r.tier, r.scenario, wav if whole else None, ref if whole else None))
    return spark.createDataFrame(rows, "id string, tier string, scenario string, audio_path string, ref_path string").withColumn("rec", F.col("id"))


def _references(spark: SparkSession, args: argparse.Namespace, items: DataFrame, tracks: DataFrame) -> DataFrame:
    """States by the items' ref_path or, if given, of one table (rec, frame, state)."""
    if args.references:
        return spark.read.parquet(args.references)
    return references.load(items, tracks.groupBy("rec").agg(F.count("*").alias("n_frames")))


def _prepared(args: argparse.Namespace, out: str) -> tuple[SparkSession, DataFrame, DataFrame, DataFrame]:
    spark = session()
    items = items_of(spark, args, out)
    tracks = annotate.kept(out)(annotate.evidence(audio.frames(audio.listed(items))), "evidence")
    return spark, items, tracks, _references(spark, args, items, tracks)


def evaluate(args: argparse.Namespace) -> None:
    """Scorecard of a suite's or manifest's recordings against their reference states."""
    out, tuning = _out(args), _tuning(args)
    _, items, tracks, refs = _prepared(args, out)
    card = annotate.evaluate(items, annotate.decoded(tracks, tuning, keep=annotate.kept(out)), refs)
    artifacts.write_scorecard(card, out, {"params": asdict(tuning), "run_id": args.run_id})


def tune(args: argparse.Namespace) -> None:
    """Scorecards of the grid against a baseline scorecard, and a leaderboard; fails after all ran if a guardrail does."""
    out = _out(args)
    spark, items, tracks, refs = _prepared(args, out)
    baseline = evaluation.latest(artifacts.read_scorecard(spark, args.baseline), F.col("id"))
    failed, board = [], None
    for k, tuning in enumerate(decode.GRID):
        at = f"{out}/{k}"
        artifacts.write_scorecard(annotate.evaluate(items, annotate.decoded(tracks, tuning, keep=annotate.kept(at)), refs), at, {"params": asdict(tuning), "run_id": args.run_id})
        delta = evaluation.deltas(baseline, evaluation.latest(artifacts.read_scorecard(spark, at), F.col("id")))
        found = evaluation.findings(delta, params_changed=bool(evaluation.changed_params(asdict(decode.GRID[0]), asdict(tuning))))
        artifacts.write_delta(delta, found, at, asdict(tuning), args.baseline, {"run_id": args.run_id})
        failed += [(k, r.rule, r.id) for r in found.where("kind = 'failure'").collect()]  # a manifest's items
        row = evaluation.board_row(k, delta)
        board = row if board is None else board.unionByName(row)
    artifacts.write_leaderboard(evaluation.leaderboard(board), out)
    if failed:
        raise RuntimeError(f"guardrails: {failed}")


def asr_setup(args: argparse.Namespace) -> None:
    """Where the recogniser's model is expected, and whether it is there."""
    for k, v in recognisers.Whisper(args.asr_model, args.asr_model_path, args.asr_model_dir, args.language).status().items():
        print(f"{k}: {v}")


COMMANDS = {"run": run, "evidence": evidence, "decode": decode_tracks, "eval": evaluate, "tune": tune, "asr-setup": asr_setup}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxframe", description="annotation of two-party conversations on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        c = sub.add_parser(name, help=f.__doc__)
        if name in ("run", "evidence", "decode"):
            c.add_argument("path", help="folder of recordings, or of tracks")
        if name != "asr-setup":
            c.add_argument("--out", default=None, help="folder or URI")
            c.add_argument("--run-id", default=None)
            c.add_argument("--speaker-switch", type=float, default=-6.0)
            c.add_argument("--leak-entry", type=float, default=-2.0)
            c.add_argument("--overlap", type=float, default=-3.0)
            c.add_argument("--silence-bias", type=float, default=0.0)
            c.add_argument("--high-recall", action="store_true")
        if name == "evidence":
            c.add_argument("--cache", default=None, help="folder or URI of a cache of tracks")
        if name == "run":
            c.add_argument("--leakage", action="store_true", help="compute and use leakage evidence")
            c.add_argument("--asr", default=None, help='"whisper", or module:function of a recogniser')
        if name in ("run", "asr-setup"):
            c.add_argument("--asr-model", choices=recognisers.MODELS, default="base")
            c.add_argument("--asr-model-path", default=None)
            c.add_argument("--asr-model-dir", default=None)
            c.add_argument("--language", default=None)
        if name in ("eval", "tune"):
            c.add_argument("--manifest", default=None)
            c.add_argument("--suite", default=None)
            c.add_argument("--segments", nargs="*", help="ids or tiers to keep")
            c.add_argument("--references", default=None, help="table of reference states instead of the items' ref_path")
        if name == "tune":
            c.add_argument("--baseline", required=True, help="scorecard: its folder, or its document")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.run_id = getattr(args, "run_id", None) or new_run_id()
    settings = config.RunConfig(prefix="VOXFRAME_").from_env()
    log = logs.configure(settings, args.run_id)
    tasks = Tasks(report := Report(settings, args.run_id))
    tasks.add(args.command, lambda: COMMANDS[args.command](args))
    log.debug("starts", extra={"step": args.command})
    tasks.run()
    (log.error if report.exit_code else log.info)(report.summary(), extra={"step": args.command})
    return report.exit_code


if __name__ == "__main__":
    sys.exit(main())
