"""Track archives of NumPy arrays (.npz): one archive per track, with its description, or one per recording."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "rec string, track string, semantics string, hop_s double, n_frames long, frame long, k int, value double, confidence double"
# fixed values: the names under which archives hold these
VALUES, CONFIDENCE, DESCRIPTION, HOP, DURATION = "values", "confidence", "metadata_json", "frame_hop", "duration"


def _rows(rec: str, name: str, semantics: str | None, hop: float, n_frames: int | None, values: np.ndarray, confidence: np.ndarray | None) -> pd.DataFrame:
    wide = values.reshape(len(values), -1) if values.size else values.reshape(0, 1)
    n, k = wide.shape
    sure = None if confidence is None else np.asarray(confidence, dtype=float).reshape(len(confidence), -1)
    held = np.full((n, k), np.nan) if sure is None else np.broadcast_to(sure, (n, k))
    out = pd.DataFrame({"frame": np.repeat(np.arange(n), k), "k": np.tile(np.arange(k, dtype=np.int32), n), "value": wide.astype(float).ravel(), "confidence": pd.array(held.ravel(), dtype="Float64") if sure is not None else pd.array([None] * (n * k), dtype="Float64")})
    return out.assign(rec=rec, track=name, semantics=semantics, hop_s=float(hop), n_frames=n if n_frames is None else n_frames)[[c.split()[0] for c in FRAMES.split(", ")]]


def tracks_of(rec: str, content: bytes, description: dict | None = None) -> Iterator[pd.DataFrame]:
    """The tracks of one archive: described by itself, by its entry in a bundle's manifest, or only by the names of its arrays."""
    with np.load(io.BytesIO(content), allow_pickle=False) as data:
        if DESCRIPTION in data.files or description is not None:
            about = description or json.loads(str(data[DESCRIPTION]))
            base = about["timebase"]
            yield _rows(rec, about["name"], about["semantics"], base["hop_s"], base.get("n_frames"), data[VALUES], data[CONFIDENCE] if CONFIDENCE in data.files else None)
        elif HOP in data.files:
            for name in data.files:
                if name not in (HOP, DURATION):
                    yield _rows(rec, name, None, float(data[HOP]), None, data[name], None)
        else:
            raise ValueError(f"{rec}: an archive without {DESCRIPTION} and {HOP} is no track")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All tracks of the .npz archives under path as a long table; rec is the archive's path without track and suffix."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.[nN][pP][zZ]").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"]):
                yield from tracks_of(at.rsplit("/", 1)[0], content)

    return held.mapInPandas(run, FRAMES)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The tracks of a bundle: a folder with manifest.json and an archive per track that it names."""
    from voxframe.sources import files

    entries = {e["file"]: {**e, "name": name} for name, e in json.loads(files.read_text(spark, f"{path}/manifest.json"))["tracks"].items()}
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).withColumn("file", F.element_at(F.split("path", "/"), -1)).where(F.col("file").isin(*entries)).select("file", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                yield from tracks_of(path, content, entries[name])

    return held.mapInPandas(run, FRAMES)


def archive(name: str, values: np.ndarray, semantics: str, hop_s: float, confidence: np.ndarray | None = None, metadata: dict | None = None) -> tuple[bytes, dict]:
    """One track as an archive, and its description."""
    about = {"name": name, "semantics": semantics, "timebase": {"hop_s": hop_s, "n_frames": len(values)}, "metadata": metadata or {}, "has_confidence": confidence is not None}
    out = io.BytesIO()
    arrays = {VALUES: np.asarray(values)} | ({} if confidence is None else {CONFIDENCE: np.asarray(confidence)})
    np.savez_compressed(out, **arrays, **{DESCRIPTION: np.array(json.dumps(about))})
    return out.getvalue(), about


def write_bundles(frames: DataFrame, path: str, hop_s: float, semantics: dict[str, str] | None = None) -> DataFrame:
    """frames(rec, track, frame, value), k = 0 -> rec, file, content: an archive per track and, as manifest.json, what they
    are. Written as a table of files, which a driver or a copy job puts where they belong; a recording fits in a task."""
    kinds = semantics or {}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows, entries = [], {}
        for name, track in part.sort_values("frame").groupby("track"):
            content, about = archive(name, track["value"].to_numpy(), kinds.get(name, "probability"), hop_s)
            rows.append((part["rec"].iloc[0], f"{name}.npz", content))
            entries[name] = about | {"file": f"{name}.npz"}
        n = max(e["timebase"]["n_frames"] for e in entries.values())
        rows.append((part["rec"].iloc[0], "manifest.json", json.dumps({"timebase": {"hop_s": hop_s, "n_frames": n}, "tracks": entries}, indent=2).encode()))
        return pd.DataFrame(rows, columns=["rec", "file", "content"])

    out = frames.select("rec", "track", "frame", "value").groupBy("rec").applyInPandas(run, f"rec {frames.schema['rec'].dataType.simpleString()}, file string, content binary")
    out.write.mode("overwrite").parquet(path)
    return frames.sparkSession.read.parquet(path)
