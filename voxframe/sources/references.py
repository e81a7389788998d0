"""Reference states of recordings from the files that a manifest names: lists in JSON, NumPy arrays, TextGrids."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators import segments, textgrid
from voxframe.operators.timebase import HOP_S

#: What each kind of file is named like, in lower case.
KINDS = ("npy", "json", "textgrid")


class _PlainObjects(pickle.Unpickler):
    """Unpickles arrays of strings and numbers, and calls nothing else that a file may name."""

    ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"), ("numpy.core.multiarray", "scalar")}

    def find_class(self, module: str, name: str):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed in an array of states")
        return super().find_class(module, name)


def read_npy(content: bytes) -> list[str]:
    """The states of a .npy file, as strings or as objects."""
    stream = io.BytesIO(content)
    version = np.lib.format.read_magic(stream)
    header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    _, _, kind = header(stream)
    if kind.hasobject:
        return [str(x) for x in np.asarray(_PlainObjects(stream).load(), dtype=object).ravel()]
    return [str(x) for x in np.load(io.BytesIO(content), allow_pickle=False).ravel()]


def write_npy(states: list[str]) -> bytes:
    """States as an array of strings, which any NumPy reads without unpickling."""
    out = io.BytesIO()
    np.save(out, np.array(states, dtype=str), allow_pickle=False)
    return out.getvalue()


def _listed(table: DataFrame) -> DataFrame:
    return table.select("rec", F.posexplode("states").alias("frame", "state")).select("rec", F.col("frame").cast("long").alias("frame"), "state")


def load(items: DataFrame, lengths: DataFrame, hop_s: float = HOP_S) -> DataFrame:
    """items(rec, ref_path), of which some name no file, and lengths(rec, n_frames) -> rec, frame, state of those that do. The
    suffix tells the kind; another is an error. TextGrids become frames by the recording's length. A manifest is short, so its
    paths come to the driver, but no file does."""
    spark = items.sparkSession
    named = items.where("ref_path is not null").select("rec", "ref_path")
    paths = [(r.rec, r.ref_path) for r in named.collect()]
    out = spark.createDataFrame([], f"rec {items.schema['rec'].dataType.simpleString()}, frame long, state string")
    by_kind: dict[str, list[tuple]] = {}
    for rec, path in paths:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind not in KINDS:
            raise ValueError(f"unsupported reference format: {path}")
        by_kind.setdefault(kind, []).append((rec, path))
    for kind, mine in by_kind.items():
        files = spark.read.format("binaryFile").load([p for _, p in mine]).select("path", "content")
        # readers give full URIs, so paths meet by what they end in
        asked = spark.createDataFrame(mine, f"rec {items.schema['rec'].dataType.simpleString()}, asked string").withColumn("asked", F.regexp_replace("asked", "^[a-z0-9]+:/+", "/"))
        found = F.broadcast(asked).join(files, F.col("path").endswith(F.col("asked")))  # a manifest's lines
        if kind == "json":
            out = out.unionByName(_listed(found.select("rec", F.from_json(F.decode("content", "UTF-8"), "array<string>").alias("states"))))
        elif kind == "npy":
            out = out.unionByName(_listed(_arrays(found)))
        else:
            tiers = textgrid.parse(found.select("rec", F.decode("content", "UTF-8").alias("document")))
            label = F.element_at(F.create_map(*[F.lit(x) for state, tier in textgrid.TIER_OF.items() for x in (tier, state)]), F.col("tier"))
            mine_only = lengths.join(found.select("rec").distinct(), "rec", "left_semi")
            out = out.unionByName(segments.rasterize(tiers.select("rec", label.alias("label"), "start_time", "end_time"), mine_only, hop_s))
    return out


def _arrays(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rec": batch["rec"], "states": [read_npy(c) for c in batch["content"]]})

    return found.select("rec", "content").mapInPandas(run, f"rec {found.schema['rec'].dataType.simpleString()}, states array<string>")


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    from voxframe.sources import files

    return [p for p in paths if not files.exists(spark, p)]
