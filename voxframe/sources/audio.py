"""WAV recordings as sample and frame tables, and a synthetic stress recording.

Files are read by Spark's binaryFile source, so any store that Spark reaches will do, and decoded by the standard library.
"""

from __future__ import annotations

import io
import math
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, BLOCK_S = 16_000, 0.5
#: State, frequency, left and right amplitude of the blocks of the stress recording.
STRESS = (("SIL", 0.0, 0.0, 0.0), ("A", 220.0, 0.06, 0.0018), ("SIL", 0.0, 0.0, 0.0), ("LEAK", 220.0, 0.05, 0.0005), ("SIL", 0.0, 0.0, 0.0), ("B", 330.0, 0.06, 0.06), ("SIL", 0.0, 0.0, 0.0))


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples x channels in -1..1 of PCM with 8, 16, 24 or 32 bits, or of FLAC."""
    if content[:4] == b"fLaC":
        import soundfile  # only where that library is installed

        x, rate = soundfile.read(io.BytesIO(content), always_2d=True)
        return rate, x
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels)


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    samples = np.atleast_2d(samples.T).T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def files(spark: SparkSession, folder: str | list[str], described: bool = False) -> DataFrame:
    """rec (the file's path) and content of the .wav and .flac files, whatever the case of the suffix; described adds length
    and modificationTime."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[wW][aA][vV],[fF][lL][aA][cC]}").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("rec"), *(["length", "modificationTime"] if described else []), "content")


def listed(items: DataFrame) -> DataFrame:
    """items(id, audio_path) -> rec (the id) and content of the recordings that a manifest names; a short list."""
    spark = items.sparkSession
    rows = [(str(r.id), r.audio_path) for r in items.where("audio_path is not null").select("id", "audio_path").collect()]
    if not rows:
        return spark.createDataFrame([], "rec string, content binary")
    asked = spark.createDataFrame([(i, re.sub(r"^[a-z0-9]+:/+", "/", p)) for i, p in rows], "id string, asked string")
    return F.broadcast(asked).join(files(spark, [p for _, p in rows]), F.col("rec").endswith(F.col("asked"))).select(F.col("id").alias("rec"), "content")


def frames(recordings: DataFrame, hop_s: float = 0.01, channels: int | None = 2, channel: int | None = None, exact: bool = False) -> DataFrame:
    """recordings(rec, content) -> rec, rate, frame and, with channels=2, left and right, else samples (of one channel, or
    the mean of all). Only whole frames. More than two channels: the first two, unless exact; fewer are an error."""
    schema = "rec string, rate int, frame long, " + ("left array<double>, right array<double>" if channels == 2 else "samples array<double>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rec, content in zip(batch["rec"], batch["content"]):
                rate, x = decode_wav(content)
                if channels == 2 and (x.shape[1] < 2 or exact and x.shape[1] != 2):
                    raise ValueError(f"{rec}: requires stereo, has {x.shape[1]} channels")
                if channel is not None and not 0 <= channel < x.shape[1]:
                    raise ValueError(f"{rec}: no channel {channel}")
                hop = round(rate * hop_s)
                if hop < 1:
                    raise ValueError("the hop is shorter than a sample")
                n = len(x) // hop
                cut = x[: n * hop].reshape(n, hop, x.shape[1])
                out = {"rec": rec, "rate": rate, "frame": np.arange(n)}
                if channels == 2:
                    out |= {"left": list(cut[:, :, 0]), "right": list(cut[:, :, 1])}
                else:
                    out["samples"] = list(cut[:, :, channel] if channel is not None else cut.mean(2))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return recordings.select("rec", "content").mapInPandas(run, schema)


def stress_samples(spark: SparkSession) -> DataFrame:
    """sample, left, right, state of the stress recording, from spark.range and expressions alone."""
    size = int(BLOCK_S * RATE)

    def pick(k: int) -> Column:
        out = F.lit(STRESS[0][k])
        for i, block in enumerate(STRESS):
            out = F.when(F.col("block") == i, F.lit(block[k])).otherwise(out)
        return out

    at = spark.range(size * len(STRESS)).select(F.col("id").alias("sample"), F.floor(F.col("id") / size).alias("block"))
    tone = F.sin(F.lit(2 * math.pi) * pick(1) * (F.col("sample") % size).cast("double") / F.lit(float(RATE)))
    return at.select("sample", (pick(2) * tone).alias("left"), (pick(3) * tone).alias("right"), pick(0).alias("state"))


def stress_reference(spark: SparkSession, rec: str, hop_s: float = 0.01) -> DataFrame:
    n = round(BLOCK_S / hop_s)
    names = F.array(*[F.lit(b[0]) for b in STRESS])
    return spark.range(n * len(STRESS)).select(F.lit(rec).alias("rec"), F.col("id").alias("frame"), F.element_at(names, (F.floor(F.col("id") / n) + 1).cast("int")).alias("state"))


def stress_files(spark: SparkSession, item: str, folder: str) -> tuple[str, str]:
    """The stress recording and its states as files in folder: the paths of a .wav and of a .npy. 56,000 samples."""
    from voxframe.sources import files as small
    from voxframe.sources import references

    rows = stress_samples(spark).orderBy("sample").toPandas()
    wav, npy = f"{folder}/{item}.wav", f"{folder}/{item}_ref.npy"
    small.write_bytes(spark, wav, encode_wav(rows[["left", "right"]].to_numpy()))
    small.write_bytes(spark, npy, references.write_npy([r.state for r in stress_reference(spark, item).orderBy("frame").collect()]))
    return wav, npy


def block_track(spark: SparkSession, rec: str, blocks: list[tuple[str, int]], inside: tuple[str, ...], on: float, off: float) -> DataFrame:
    """A track over blocks of (state, frames): on where the state is one of inside, else off. The blocks are a driver list."""
    ends = np.cumsum([n for _, n in blocks]).tolist()
    state = F.lit(blocks[-1][0])
    for (name, _), end in list(zip(blocks, ends))[::-1]:
        state = F.when(F.col("frame") < end, F.lit(name)).otherwise(state)
    return spark.range(ends[-1]).select(F.lit(rec).alias("rec"), F.col("id").alias("frame")).withColumn("value", F.when(state.isin(*inside), F.lit(on)).otherwise(F.lit(off)))


def vad_track(spark: SparkSession, rec: str, blocks: list[tuple[str, int]], on: float = 0.95, off: float = 0.05) -> DataFrame:
    return block_track(spark, rec, blocks, ("A", "B", "OVL"), on, off)


def diar_track(spark: SparkSession, rec: str, blocks: list[tuple[str, int]], speaker: str, on: float = 0.9, off: float = 0.1) -> DataFrame:
    return block_track(spark, rec, blocks, (speaker, "OVL"), on, off)


def leak_track(spark: SparkSession, rec: str, blocks: list[tuple[str, int]], on: float = 0.7, off: float = 0.05) -> DataFrame:
    return block_track(spark, rec, blocks, ("LEAK",), on, off)


def regions(lengths: list[int]) -> list[tuple[int, int]]:
    """First and one past the last frame of blocks one after another."""
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends[:-1]], ends))


def scripted_scores(spark: SparkSession, rec: str, blocks: list[tuple[str, int]], high: float = 6.0, low: float = 0.0) -> DataFrame:
    """Scores in which each block's state is high and the others low."""
    names = {"SIL": "s_sil", "A": "s_a", "B": "s_b", "OVL": "s_ovl", "LEAK": "s_leak"}
    parts = [block_track(spark, rec, blocks, (state,), high, low).withColumnRenamed("value", column) for state, column in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["rec", "frame"])
    return out


def seeded_scores(spark: SparkSession, rec: str, frames: int, seed: int = 0) -> DataFrame:
    """Normal scores from hashes of (seed, frame, state): the same in every partitioning."""
    u = lambda k, salt: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k), F.lit(salt)), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    normal = lambda k: F.sqrt(F.lit(-2.0) * F.log(u(k, 0))) * F.cos(F.lit(2 * math.pi) * u(k, 1))
    return spark.range(frames).select(F.lit(rec).alias("rec"), F.col("id").alias("frame"), *(normal(k).alias(c) for k, c in enumerate(("s_sil", "s_a", "s_b", "s_ovl", "s_leak"))))
