"""Typed JSON artifacts, scorecards, manifests and track tables as Spark sources and sinks."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from voxframe.operators import evaluation, textgrid
from voxframe.sources import files

WORD = "struct<text:string,start:double,end:double,speaker:string,confidence:double>"
SEGMENT = "struct<label:string,speaker:string,start:double,end:double>"
SCHEMAS = {
    "transcript": f"type string, rec string, language string, words array<{WORD}>",
    "alignment": f"type string, rec string, words array<{WORD}>, phonemes array<struct<phoneme:string,start:double,end:double>>",
    "ipus": f"type string, rec string, segments array<{SEGMENT}>",
    "states": f"type string, rec string, segments array<{SEGMENT}>",
    "diagnostics": "type string, rec string, metrics map<string,double>, flags array<string>",
}
CARD = "id string, tier string, status string, audio_path string, boundary_f1_20ms double, boundary_f1_50ms double, iou_a double, iou_b double, iou_any double, micro_ipus_per_min double, switches_per_min double, rapid_alternations double, rapid_alternations_per_min double"
CARD_SCHEMA = StructType([StructField(n, StringType() if t == "string" else DoubleType()) for n, t in (c.split() for c in CARD.split(", "))])
MANIFEST = "id string, tier string, scenario string, audio_path string, ref_path string"


def word_order(words: Column) -> Column:
    """By start (missing: last), end and text."""
    keyed = F.transform(words, lambda w: F.struct(F.coalesce(w.start, F.lit(float("inf"))).alias("a"), F.coalesce(w.end, w.start, F.lit(float("inf"))).alias("b"), w.text.alias("t"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda x: x.w)


def write(df: DataFrame, kind: str, path: str) -> None:
    """One JSON document per row (a recording), tagged with its type; words in time order; nulls are left out."""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown artifact type {kind!r}")
    out = df.withColumn("words", word_order(F.col("words"))) if "words" in df.columns else df
    out.withColumn("type", F.lit(kind)).write.mode("overwrite").json(path)


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Documents of a type, words in time order; a document of another type is an error when it is reached."""
    df = spark.read.schema(SCHEMAS[kind]).json(path)
    right = F.when(F.col("type") == kind, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected an artifact of type {kind}, found "), F.coalesce("type", F.lit("none")))).cast("boolean"))
    df = df.where(right)
    return df.withColumn("words", word_order(F.col("words"))) if "words" in df.columns else df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path).orderBy("tier", "id")


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """rec, tier, start_time, end_time, label of the TextGrid files under path."""
    return textgrid.parse(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("rec"), F.col("value").alias("document")))


def write_textgrids(documents: DataFrame, path: str) -> None:
    """One text file per recording, in a folder named by it."""
    documents.select("rec", F.col("document").alias("value")).repartition("rec").write.mode("overwrite").partitionBy("rec").text(path)


def _numbers(rows: list) -> list[dict]:
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]


def write_scorecard(rows: DataFrame, path: str, metadata: dict | None = None) -> None:
    """results as CSV with a header and as JSON lines, in order of tier and id, and scorecard.json with the results, their
    means over all and by tier, and metadata. One row an item of a manifest: small tables."""
    held = rows.orderBy("tier", "id").coalesce(1)
    held.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    held.write.mode("overwrite").json(f"{path}/json")
    spark = rows.sparkSession
    back = spark.read.schema(rows.schema).json(f"{path}/json")
    metrics = tuple(f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name != "id")
    means = {r.tier: {k: v for k, v in r.asDict().items() if k != "tier"} for r in evaluation.by_tier(back, metrics).collect()} if metrics else {}
    document = {"results": _numbers(back.orderBy("tier", "id").collect()), "summary": means.pop(None, {}), "by_tier": means, "metadata": metadata or {}}
    files.write_text(spark, f"{path}/scorecard.json", json.dumps(document, indent=2, sort_keys=True, default=str))


def read_scorecard(spark: SparkSession, path: str) -> DataFrame:
    """The results of a scorecard: a folder that write_scorecard wrote, or its document alone."""
    if path.endswith(".json"):
        rows = json.loads(files.read_text(spark, path))["results"]
        return spark.createDataFrame([tuple(r.get(f.name) if f.dataType.typeName() != "double" or r.get(f.name) is None else float(r[f.name]) for f in CARD_SCHEMA.fields) for r in rows], CARD_SCHEMA)
    return spark.read.schema(CARD).json(f"{path}/json")


def write_delta(delta: DataFrame, findings: DataFrame, path: str, params: dict, baseline: str, metadata: dict | None = None) -> None:
    """delta.json, with what it compares and the guardrails' findings, and the rows as CSV."""
    spark = delta.sparkSession
    delta.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/delta")
    found = findings.collect()  # a manifest's items
    summary = {str(r.tier): {k: v for k, v in r.asDict().items() if k != "tier"} for r in evaluation.delta_summary(delta).collect()}
    named = lambda kind: [f"{r.rule}: {r.id}" if r.id is not None else r.rule for r in found if r.kind == kind]
    held = f"{baseline}/scorecard.json" if not baseline.endswith(".json") else baseline
    sha1 = hashlib.sha1(files.read_text(spark, held).encode()).hexdigest() if files.exists(spark, held) else None
    document = {"params": params, "baseline": {"path": baseline, "sha1": sha1}, "metadata": metadata or {}, "rows": _numbers(delta.orderBy("tier", "id").collect()), "summary": summary, "failed": any(r.kind == "failure" for r in found), "failures": named("failure"), "warnings": named("warning")}
    files.write_text(spark, f"{path}/delta.json", json.dumps(document, indent=2, sort_keys=True, default=str))


def write_leaderboard(board: DataFrame, path: str) -> None:
    """leaderboard.json and leaderboard.csv, in order of place; one row a candidate."""
    spark = board.sparkSession
    rows = [r.asDict() for r in board.orderBy("place").collect()]
    files.write_text(spark, f"{path}/leaderboard.json", json.dumps(rows, indent=2, sort_keys=True))
    text = "\n".join([",".join(board.columns), *(",".join(str(r[c]) for c in board.columns) for r in rows)])
    files.write_text(spark, f"{path}/leaderboard.csv", text + "\n")


def write_run_metadata(spark: SparkSession, path: str, run_id: str, audio_path: str | None, steps: list[str], version: str, duration: float | None = None) -> None:
    about = {"run_id": run_id, "audio_path": audio_path, "duration": duration, "timestamp": datetime.now(timezone.utc).isoformat(), "version": version, "pipeline_steps": steps}
    files.write_text(spark, f"{path}/metadata.json", json.dumps(about, indent=2, sort_keys=True))


def write_tracks(frames: DataFrame, path: str) -> None:
    """Track frames as Parquet, one folder per track: a reader of some tracks opens no other."""
    frames.write.mode("overwrite").partitionBy("track").parquet(path)


def read_tracks(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("track").isin(*names)) if names else df
