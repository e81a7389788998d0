"""Agreement and stability metrics of state paths."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxframe.operators.decode import counters, recordings
from voxframe.operators.segments import by_frame
from voxframe.operators.spread import spread
from voxframe.operators.timebase import HOP_S

MASKS = {"iou_a": ("A", "OVL"), "iou_b": ("B", "OVL"), "iou_any": ("A", "B", "OVL", "LEAK")}


def matched(ref: np.ndarray, hyp: np.ndarray, tol_s: float) -> int:
    """How many of hyp, in order, find an unused one of ref within tol_s, each taking the closest, the earlier in a tie."""
    ref, hyp = np.sort(ref), np.sort(hyp)
    used = np.zeros(len(ref), dtype=bool)
    hits = 0
    for h in hyp:
        # candidates lie around h; one more on each side in case of rounding
        a, b = max(0, np.searchsorted(ref, h - tol_s) - 1), np.searchsorted(ref, h + tol_s, side="right") + 1
        near = [(abs(ref[i] - h), i) for i in range(a, min(b, len(ref))) if not used[i] and abs(ref[i] - h) <= tol_s]
        if near:
            used[min(near)[1]] = True
            hits += 1
    return hits


def boundary_scores(ref: DataFrame, hyp: DataFrame, tol_s: float, recs: DataFrame) -> DataFrame:
    """ref, hyp(rec, time_s); recs(rec) -> rec, tp, fp, fn, precision, recall, f1; 0 where there is nothing to divide."""
    rec = recs.schema["rec"].dataType.simpleString()

    def match(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rec": [key[0]], "tp": [matched(a["time_s"].to_numpy(), b["time_s"].to_numpy(), tol_s)]})

    tp = ref.select("rec", "time_s").groupBy("rec").cogroup(hyp.select("rec", "time_s").groupBy("rec")).applyInPandas(match, f"rec {rec}, tp long")
    count = lambda d, n: d.groupBy("rec").agg(F.count("*").alias(n))
    joined = recs.select("rec").distinct().join(tp, "rec", "left").join(count(ref, "n_ref"), "rec", "left").join(count(hyp, "n_hyp"), "rec", "left").na.fill(0, ["tp", "n_ref", "n_hyp"])
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    out = joined.withColumn("fp", F.col("n_hyp") - F.col("tp")).withColumn("fn", F.col("n_ref") - F.col("tp")).withColumn("precision", share(F.col("tp"), F.col("n_hyp"))).withColumn("recall", share(F.col("tp"), F.col("n_ref")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both)).otherwise(F.lit(0.0))).drop("n_ref", "n_hyp")


def iou(ref: Column, hyp: Column) -> Column:
    """Aggregate: frames in both over frames in either; 1 if none is in either."""
    either = F.count_if(ref | hyp)
    return F.when(either == 0, F.lit(1.0)).otherwise(F.count_if(ref & hyp) / F.when(either != 0, either))


def framewise(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Intersection over union of the masks, over the frames that both have."""
    both = ref.select("rec", "frame", F.col("state").alias("r")).join(hyp.select("rec", "frame", F.col("state").alias("h")), ["rec", "frame"])
    return both.groupBy("rec").agg(*(iou(F.col("r").isin(*labels), F.col("h").isin(*labels)).alias(name) for name, labels in MASKS.items()))


def per_minute(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / (F.when(seconds > 0, seconds) / F.lit(60.0))).otherwise(F.lit(0.0))


def micro_ipus(segments: DataFrame, durations: DataFrame, max_s: float = 0.2) -> DataFrame:
    """Segments under max_s a minute; durations(rec, total_s) holds the recordings."""
    short = segments.groupBy("rec").agg(F.count_if(F.col("end_time") - F.col("start_time") < F.lit(max_s)).alias("n"))
    return durations.join(short, "rec", "left").select("rec", per_minute(F.coalesce("n", F.lit(0)), F.col("total_s")).alias("micro_ipus_per_min"))


def speaker_switches(states: DataFrame, hop_s: float = HOP_S) -> DataFrame:
    """Changes between A and B, other states left out, a minute of the whole recording."""
    total = states.groupBy("rec").agg((F.count("*") * F.lit(hop_s)).alias("total_s"))
    spoken = states.where(F.col("state").isin("A", "B")).withColumn("before", F.lag("state").over(by_frame()))
    switches = spoken.groupBy("rec").agg(F.count_if(F.col("state") != F.col("before")).alias("n"))
    return total.join(switches, "rec", "left").select("rec", per_minute(F.coalesce("n", F.lit(0)), F.col("total_s")).alias("switches_per_min"))


def rapid_alternations(states: DataFrame) -> DataFrame:
    """Triples A B A or B A B of consecutive frames."""
    marked = states.withColumn("one", F.lead("state", 1).over(by_frame())).withColumn("two", F.lead("state", 2).over(by_frame()))
    hit = F.col("state").isin("A", "B") & F.col("one").isin("A", "B") & (F.col("state") != F.col("one")) & (F.col("state") == F.col("two"))
    return marked.groupBy("rec").agg(F.count_if(hit).alias("rapid_alternations"), F.count("*").alias("n_frames"))


def run_counters(states: DataFrame, segments: DataFrame) -> DataFrame:
    """Per recording: runs that begin right after leakage, speech segments, leakage segments."""
    total = segments.groupBy("rec").agg(F.count_if(F.col("label").isin("A", "B", "OVL")).alias("total_ipus"), F.count_if(F.col("label") == "LEAK").alias("leak_segments"))
    return counters(states).join(total, "rec", "left").na.fill(0, ["total_ipus", "leak_segments"])


PATH_SCHEMA = "iou_a double, iou_b double, iou_any double, boundary_f1_20ms double, boundary_f1_50ms double, short long, n_frames long, switches long, rapid_alternations long"


def f1_score(ref: np.ndarray, hyp: np.ndarray, tol_s: float) -> float:
    tp = matched(ref, hyp, tol_s)
    precision, recall = tp / len(hyp) if len(hyp) else 0.0, tp / len(ref) if len(ref) else 0.0
    return 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


def short_runs(frame: np.ndarray, code: np.ndarray, least_s: float, hop_s: float, max_s: float = 0.2) -> int:
    """How many runs of a path last least_s or more, and under max_s, as segments.ipus() and micro_ipus() count them."""
    fresh = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (code[1:] < 0) | (frame[1:] != frame[:-1] + 1)])
    first, end = frame[fresh], np.r_[frame[fresh[1:] - 1], frame[-1:]] + 1
    return int((((end - first) * hop_s >= least_s) & (end * hop_s - first * hop_s < max_s)).sum())


def path_figures(ref: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray], codes: dict[str | None, int], hop_s: float, least_s: float) -> tuple | None:
    """PATH_SCHEMA's figures of one recording's paths, each frames in order and codes of states (below 0: none); None if the
    paths, cut to the shorter one, share no frame. A path that is absent as reference is compared with itself."""
    if not len(ref[0]):
        ref = hyp
    n = min(len(ref[0]), len(hyp[0]))
    (rf, rs), (hf, hs) = (ref[0][:n], ref[1][:n]), (hyp[0][:n], hyp[1][:n])
    if np.array_equal(rf, hf) and (np.diff(hf) > 0).all():
        r, h = rs, hs
    else:
        both = pd.DataFrame({"frame": rf, "r": rs}).merge(pd.DataFrame({"frame": hf, "h": hs}), on="frame")
        r, h = both["r"].to_numpy(), both["h"].to_numpy()
    if not len(r):
        return None
    ious = []
    for labels in MASKS.values():
        held = [codes[s] for s in labels if s in codes]
        a, b = np.isin(r, held), np.isin(h, held)
        either = int((a | b).sum())
        ious.append(int((a & b).sum()) / either if either else 1.0)
    changes = lambda f, s: f[1:][(s[1:] != s[:-1]) & (s[1:] >= 0) & (s[:-1] >= 0)] * hop_s
    f1 = [f1_score(changes(rf, rs), changes(hf, hs), ms / 1000) for ms in (20, 50)]
    said = np.isin(hs, [codes[s] for s in ("A", "B") if s in codes])
    spoken = hs[said]
    rapid = said[:-2] & said[1:-1] & (hs[:-2] != hs[1:-1]) & (hs[:-2] == hs[2:])
    return (*ious, *f1, short_runs(*hyp, least_s, hop_s), n, int((spoken[1:] != spoken[:-1]).sum()), int(rapid.sum()))


def side_by_side(paths: DataFrame) -> DataFrame:
    """paths(rec, path, frame, state) with the rows of a recording together, by path and frame; without a recording: none."""
    rows = paths.where("rec is not null").select("rec", F.col("path").cast("int").alias("path"), F.col("frame").cast("long").alias("frame"), "state")
    return spread(rows, "rec", always=True).sortWithinPartitions("rec", "path", "frame")


def path_scores(paths: DataFrame, hop_s: float = HOP_S, least_s: float = 0.0) -> DataFrame:
    """All metrics per recording, in one pass over paths as side_by_side() gives them: path 0 is the reference, 1 the path to
    judge; segments are the runs of that one that last least_s. One recording must fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str | None, int] = {None: -1}
        out: list[tuple] = []
        for one in recordings(batches):
            named = one.column(3).combine_chunks().dictionary_encode()
            names = np.array([codes.setdefault(s, len(codes)) for s in named.dictionary.to_pylist()] + [-1], dtype=np.int64)
            code = names[named.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)]
            frame, at = one.column(2).to_numpy(), int(np.searchsorted(one.column(1).to_numpy(), 1))
            if at < len(frame) and (found := path_figures((frame[:at], code[:at]), (frame[at:], code[at:]), codes, hop_s, least_s)):
                out.append((one.column(0)[0].as_py(), *found))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa_kind) for c, pa_kind in zip(zip(*out), kinds)], names=["rec", *(c.split()[0] for c in PATH_SCHEMA.split(", "))])

    rec = paths.schema["rec"].dataType
    kinds = [to_arrow_type(rec), *(pa.float64() if c.endswith("double") else pa.int64() for c in PATH_SCHEMA.split(", "))]
    found = paths.select("rec", "path", "frame", "state").mapInArrow(run, f"rec {rec.simpleString()}, {PATH_SCHEMA}")
    total = F.col("n_frames") * F.lit(hop_s)
    minute = lambda name: per_minute(F.col(name), total).alias(f"{name}_per_min")
    rapid = (F.col("rapid_alternations") / F.greatest(total / F.lit(60.0), F.lit(1e-9))).alias("rapid_alternations_per_min")
    return found.select("rec", *MASKS, "boundary_f1_20ms", "boundary_f1_50ms", minute("short").alias("micro_ipus_per_min"), minute("switches"), "rapid_alternations", rapid, "n_frames")


def scores(ref: DataFrame, hyp: DataFrame, segments: DataFrame, hop_s: float = HOP_S) -> DataFrame:
    """All metrics per recording of hyp; a recording that ref lacks is compared with itself."""
    path = lambda d, k: d.select("rec", F.lit(k).alias("path"), "frame", "state")
    out = path_scores(side_by_side(path(ref, 0).unionByName(path(hyp, 1))), hop_s).drop("micro_ipus_per_min")
    total = F.col("n_frames") * F.lit(hop_s)
    short = segments.groupBy("rec").agg(F.count_if(F.col("end_time") - F.col("start_time") < F.lit(0.2)).alias("short"))
    out = out.join(short, "rec", "left").withColumn("micro_ipus_per_min", per_minute(F.coalesce("short", F.lit(0)), total))
    return out.select("rec", *MASKS, "boundary_f1_20ms", "boundary_f1_50ms", "micro_ipus_per_min", "switches_per_min", "rapid_alternations", "rapid_alternations_per_min")
