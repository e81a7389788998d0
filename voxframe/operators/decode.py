"""Constrained state paths: transition penalties, least durations and Viterbi decoding of many recordings at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators.spread import spread

# fixed values: states in order, and the default model
STATES = ("SIL", "A", "B", "OVL", "LEAK")
SWITCH, SIL_EXIT, SIL_ENTER, LEAK_TO_SIL, LEAK_TO_OVL, HIGH_RECALL_SCALE = -3.0, -1.0, -0.5, -0.5, -5.0, 3.0
MIN_FRAMES = {"SIL": 2, "A": 3, "B": 3, "OVL": 3, "LEAK": 3}
NEVER = -np.inf
#: Recordings are decoded together up to so many frames.
BATCH_FRAMES = 200_000


@dataclass(frozen=True)
class Tuning:
    speaker_switch: float = -6.0
    leak_entry: float = -2.0
    overlap: float = -3.0
    a_to_overlap: float | None = None
    b_to_overlap: float | None = None
    overlap_to_a: float | None = None
    overlap_to_b: float | None = None
    high_recall: bool = False
    silence_bias: float = 0.0
    merge_gap_ms: float = 400.0

    def overlap_costs(self) -> tuple[float, float, float, float]:
        return tuple(self.overlap if v is None else v for v in (self.a_to_overlap, self.b_to_overlap, self.overlap_to_a, self.overlap_to_b))  # type: ignore[return-value]


GRID = (Tuning(), Tuning(-7.0), Tuning(-6.0, -2.5), Tuning(-7.0, -2.5, -3.5))


def penalties(tuning: Tuning = Tuning()) -> dict[tuple[str, str], float]:
    """Log penalty of each step between states."""
    a_o, b_o, o_a, o_b = tuning.overlap_costs()
    step = {(i, j): 0.0 if i == j else SWITCH for i in STATES for j in STATES}
    step |= {("A", "B"): tuning.speaker_switch, ("B", "A"): tuning.speaker_switch, ("A", "OVL"): a_o, ("B", "OVL"): b_o, ("OVL", "A"): o_a, ("OVL", "B"): o_b}
    step |= {("SIL", "OVL"): tuning.overlap, ("OVL", "SIL"): tuning.overlap, ("LEAK", "SIL"): LEAK_TO_SIL, ("LEAK", "OVL"): LEAK_TO_OVL}
    step |= {(i, "LEAK"): tuning.leak_entry for i in ("A", "B", "OVL")}
    for i in STATES[1:]:
        step["SIL", i] += SIL_EXIT
        step[i, "SIL"] += SIL_ENTER
    step |= {("SIL", "LEAK"): NEVER, ("LEAK", "A"): NEVER, ("LEAK", "B"): NEVER}
    if tuning.high_recall:
        for i in ("A", "B", "OVL"):
            step[i, "SIL"] *= HIGH_RECALL_SCALE
    return step


def least_frames(tuning: Tuning = Tuning(), given: dict[str, int] | None = None) -> dict[str, int]:
    least = MIN_FRAMES | (given or {})
    return least | {"SIL": least["SIL"] * 2} if tuning.high_recall else least


@dataclass(frozen=True)
class Model:
    """States split into chains that enforce their least durations. base: state of each substate."""

    step: np.ndarray
    base: np.ndarray
    first: np.ndarray
    names: tuple[str, ...] = field(default=STATES)


def model(tuning: Tuning = Tuning(), least: dict[str, int] | None = None, step: dict[tuple[str, str], float] | None = None, initial: dict[str, float] | None = None) -> Model:
    step = penalties(tuning) if step is None else step
    least = least_frames(tuning, least)
    subs = [(s, k) for s in STATES for k in range(max(1, least[s]))]
    at = {x: k for k, x in enumerate(subs)}
    matrix = np.full((len(subs), len(subs)), NEVER)
    for (s, k), i in at.items():
        if (s, k + 1) in at:
            matrix[i, i + 1] = 0.0
        else:
            for d in STATES:
                matrix[i, at[d, 0]] = step[s, d]
            matrix[i, i] = 0.0
    start = {"LEAK": NEVER} if initial is None else initial
    first = np.array([start.get(s, 0.0) if k == 0 else NEVER for s, k in subs])
    return Model(matrix, np.array([STATES.index(s) for s, _ in subs]), first)


def viterbi(scores: list[np.ndarray], m: Model) -> list[np.ndarray]:
    """Best state of each frame for each recording (frames x 5). All recordings step together; ties go to the lower state.
    Nothing is padded: memory follows the frames, however the lengths are mixed."""
    lengths = np.array([len(s) for s in scores], dtype=np.int64)
    out = np.zeros(int(lengths.sum()), dtype=np.int8)
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if len(order):
        emit, first, size = np.concatenate(scores), begin[order], lengths[order]
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # recordings longer than t
        best = m.first + emit[first][:, m.base]
        back = [np.zeros((0, len(m.base)), np.int8)]
        for t in range(1, size[0]):
            n = live[t]
            come = best[:n, :, None] + m.step
            back.append(come.argmax(1).astype(np.int8 if len(m.base) < 128 else np.int32))
            best[:n] = come.max(1) + emit[first[:n] + t][:, m.base]
        state = best.argmax(1)
        for t in range(size[0] - 1, -1, -1):
            n = live[t]
            out[first[:n] + t] = m.base[state[:n]]
            if t:
                state[:n] = back[t][np.arange(n), state[:n]]
    return [out[a : a + n] for a, n in zip(begin, lengths)]


def recordings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each recording, which lie side by side; a null id is one recording."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            if held and held[-1].column(0)[0].as_py() != batch.column(0)[a].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def decode_all(scores: DataFrame, models: dict[int, Model]) -> DataFrame:
    """scores(rec, frame, s_sil, s_a, s_b, s_ovl, s_leak) -> candidate, rec, frame, state, for each of some models by its
    number. One shuffle by rec, whatever the number of models; a task holds about BATCH_FRAMES frames at a time, and one
    recording at least. Rows with a null rec are one recording."""
    kind = scores.schema["rec"].dataType

    def solve(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held).combine_chunks()
        parts = [np.column_stack([t.column(k).to_numpy() for k in range(2, 7)]) for t in held]
        for number, m in models.items():
            state = pa.array(np.array(m.names, dtype=object)[np.concatenate(viterbi(parts, m))], pa.string())
            yield from pa.table([pa.array(np.full(len(state), number, np.int32)), rows.column(0), rows.column(1), state], names=["candidate", "rec", "frame", "state"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for one in recordings(batches):
            held.append(one)
            size += one.num_rows
            if size >= BATCH_FRAMES:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    dealt = scores.select("rec", F.col("frame").cast("long").alias("frame"), *(F.col(c).cast("double").alias(c) for c in ("s_sil", "s_a", "s_b", "s_ovl", "s_leak")))
    dealt = spread(dealt, "rec", always=True).sortWithinPartitions("rec", "frame")
    return dealt.mapInArrow(run, f"candidate int, rec {kind.simpleString()}, frame long, state string")


def decode(scores: DataFrame, tuning: Tuning = Tuning(), least: dict[str, int] | None = None, step: dict[tuple[str, str], float] | None = None, initial: dict[str, float] | None = None) -> DataFrame:
    """scores(rec, frame, s_sil, s_a, s_b, s_ovl, s_leak) -> rec, frame, state: decode_all for one model."""
    return decode_all(scores, {0: model(tuning, least, step, initial)}).drop("candidate")


def step_table(spark: SparkSession, tuning: Tuning = Tuning()) -> DataFrame:
    """from_state, to_state, penalty; null where the step is forbidden."""
    rows = [(i, j, None if v == NEVER else float(v)) for (i, j), v in penalties(tuning).items()]
    return spark.createDataFrame(rows, "from_state string, to_state string, penalty double")


def counters(states: DataFrame) -> DataFrame:
    """Per recording the number of runs other than SIL that begin right after LEAK."""
    before = F.lag("state").over(W.partitionBy("rec").orderBy("frame"))
    marked = states.withColumn("before", before)
    return marked.groupBy("rec").agg(F.count_if((F.col("before") == "LEAK") & ~F.col("state").isin("LEAK", "SIL")).alias("ipu_start_after_leak"))
