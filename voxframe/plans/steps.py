"""Named steps on the driver: tasks with dependencies and failure records, and a graph of DataFrame steps whose results are
kept as Parquet under a hash of what made them."""

from __future__ import annotations

import hashlib
import json
import time
import traceback
import uuid
from collections.abc import Callable, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from voxframe.sources import files
from voxframe.sources.config import RunConfig

VERSION = "1"


def new_run_id() -> str:
    """Sorts by time, and does not repeat."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


@dataclass
class Record:
    step: str
    status: str  # OK, FAILED or SKIPPED
    message: str = ""
    error: str | None = None
    trace: str | None = None
    caused_by: str | None = None
    context: Mapping[str, Any] | None = None


class Report:
    """What happened to each step; the last record of a step counts. Events go to a JSON-lines file if asked."""

    def __init__(self, config: RunConfig = RunConfig(), run_id: str | None = None):
        self.config, self.run_id = config, run_id or new_run_id()
        self.records: list[Record] = []

    def add(self, record: Record) -> None:
        self.records.append(record)
        if self.config.write_events:
            event = {"time_utc": datetime.now(timezone.utc).isoformat(), "run_id": self.run_id, "event": f"step_{record.status.lower()}", **{k: v for k, v in asdict(record).items() if v is not None and k != "trace"}}
            self.config.log_dir.mkdir(parents=True, exist_ok=True)
            with (self.config.log_dir / f"events_{self.run_id}.jsonl").open("a") as f:
                f.write(json.dumps(event, default=str) + "\n")

    def status(self, step: str) -> str | None:
        return next((r.status for r in reversed(self.records) if r.step == step), None)

    def count(self, status: str) -> int:
        return sum(self.status(s) == status for s in {r.step for r in self.records})

    @property
    def exit_code(self) -> int:
        return int(self.count("FAILED") > 0)

    def summary(self) -> str:
        lines = [f"run {self.run_id} ({self.config.mode}): " + ", ".join(f"{s} {self.count(s)}" for s in ("OK", "FAILED", "SKIPPED"))]
        return "\n".join(lines + [f"  {r.status} {r.step}: {r.error + ': ' if r.error else ''}{r.message}" for r in self.records if r.status != "OK"])

    @contextmanager
    def guard(self, step: str, context: Mapping[str, Any] | None = None):
        """Records how the block ends; in debug mode a failure goes on up."""
        try:
            yield
        except Exception as e:
            self.add(Record(step, "FAILED", str(e), type(e).__name__, traceback.format_exc(), context=context))
            if self.config.mode == "debug":
                raise
        else:
            self.add(Record(step, "OK", context=context))


class Tasks:
    """Runs functions when what they depend on is OK, in order of name; skips what depends on a failure, and everything left
    once max_failures have failed."""

    def __init__(self, report: Report):
        self.report = report
        self.steps: dict[str, tuple[Callable[[], Any], tuple[str, ...], Mapping[str, Any] | None]] = {}

    def add(self, name: str, run: Callable[[], Any], deps: tuple[str, ...] | list[str] = (), context: Mapping[str, Any] | None = None) -> None:
        if name in self.steps:
            raise ValueError(f"there is a step {name!r} already")
        self.steps[name] = (run, tuple(deps), context)

    def run(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        left = sorted(self.steps)
        most = self.report.config.max_failures if self.report.config.mode == "run" else None
        while left:
            if most is not None and self.report.count("FAILED") >= most:
                for name in left:
                    self.report.add(Record(name, "SKIPPED", "too many failures", caused_by="max_failures", context=self.steps[name][2]))
                break
            ready = next((n for n in left if all(d in self.steps and d not in left for d in self.steps[n][1])), None)
            if ready is None:
                raise RuntimeError(f"a cycle, or an unknown dependency, among {', '.join(left)}")
            left.remove(ready)
            run, deps, context = self.steps[ready]
            bad = next((d for d in deps if self.report.status(d) != "OK"), None)
            if bad is not None:
                self.report.add(Record(ready, "SKIPPED", f"{bad!r} failed or was skipped", caused_by=bad, context=context))
                continue
            with self.report.guard(ready, context):
                out[ready] = run()
        return out


# ---- graph of DataFrame steps ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Callable[[Mapping[str, Any]], Mapping[str, Any]]
    parameters: Mapping[str, Any] = field(default_factory=dict)


class Registry:
    def __init__(self):
        self.steps: dict[str, Step] = {}
        self.makers: dict[str, Step] = {}

    def register(self, step: Step) -> Step:
        taken = [o for o in step.outputs if o in self.makers]
        if step.name in self.steps or taken:
            raise ValueError(f"step {step.name!r} or its outputs {taken} are registered already")
        self.steps[step.name] = step
        self.makers |= {o: step for o in step.outputs}
        return step

    def order(self, have: set[str], targets: tuple[str, ...]) -> list[Step]:
        """The steps that targets need beyond what there is, in the order to run them."""
        out: list[Step] = []
        have = set(have)

        def need(name: str, path: tuple[str, ...]) -> None:
            if name in have:
                return
            if name in path:
                raise ValueError(f"{name!r} depends on itself")
            if name not in self.makers:
                raise ValueError(f"no step makes {name!r}")
            step = self.makers[name]
            for i in step.inputs:
                need(i, (*path, name))
            if step not in out:
                out.append(step)
                have.update(step.outputs)

        for t in targets:
            need(t, ())
        return out


def plain(value: Any) -> Any:
    """value as JSON can state it, for hashing: paths with the size and time of their file, DataFrames by their plan and all
    files that it reads, each with size and time. Of rows that a plan holds itself only Spark's hash of the plan tells."""
    if isinstance(value, Path):
        stat = value.stat() if value.exists() else None
        return {"path": str(value.resolve()), "size": stat and stat.st_size, "mtime": stat and stat.st_mtime}
    if isinstance(value, DataFrame):
        shape = value._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        read = hashlib.sha256(json.dumps(files.identities(value.sparkSession, value.inputFiles())).encode()).hexdigest()
        return {"plan": [value.semanticHash(), hashlib.sha256(shape.encode()).hexdigest()], "files": read, "schema": value.schema.json()}
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else repr(value)


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Store:
    """Step results by hash: DataFrames as Parquet, the rest as JSON. root is a path on any file system that Spark reaches;
    nothing is written but through Spark and Hadoop."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, str(root).rstrip("/")

    def folder(self, key: str) -> str:
        return f"{self.root}/cache/{key}"

    def key(self, step: Step, inputs: Mapping[str, str]) -> str:
        return digest({"version": VERSION, "step": step.name, "inputs": dict(inputs), "parameters": dict(step.parameters)})

    def has(self, key: str) -> bool:
        return files.exists(self.spark, f"{self.folder(key)}/meta.json")

    def save(self, key: str, step: Step, inputs: Mapping[str, str], result: Mapping[str, Any]) -> dict[str, Any]:
        kinds = {}
        for name, value in result.items():
            kinds[name] = "table" if isinstance(value, DataFrame) else "json"
            if isinstance(value, DataFrame):
                value.write.mode("overwrite").parquet(f"{self.folder(key)}/{name}")
            else:
                files.write_text(self.spark, f"{self.folder(key)}/{name}.json", json.dumps(value))
        meta = {"step": step.name, "inputs": dict(inputs), "parameters": plain(step.parameters), "timestamp": time.time(), "version": VERSION, "kinds": kinds}
        # last: a result without it is not whole
        files.write_text(self.spark, f"{self.folder(key)}/meta.json", json.dumps(meta, indent=2, sort_keys=True))
        return self.load(key)

    def load(self, key: str) -> dict[str, Any]:
        folder = self.folder(key)
        kinds = json.loads(files.read_text(self.spark, f"{folder}/meta.json"))["kinds"]
        return {n: self.spark.read.parquet(f"{folder}/{n}") if k == "table" else json.loads(files.read_text(self.spark, f"{folder}/{n}.json")) for n, k in kinds.items()}


def run_graph(registry: Registry, store: Store, state: Mapping[str, Any], targets: tuple[str, ...], run_id: str | None = None) -> dict[str, Any]:
    """Runs what targets need; results that are stored are taken. Records of the run are written however it ends."""
    run_id = run_id or new_run_id()
    state = dict(state)
    hashes = {k: digest(v) for k, v in state.items()}
    log: list[dict[str, Any]] = []
    try:
        for step in registry.order(set(state), targets):
            inputs = {i: hashes[i] for i in step.inputs}
            key = store.key(step, inputs)
            entry = {"step": step.name, "hash": key, "inputs": inputs, "outputs": list(step.outputs), "start_time": time.time(), "status": "failed"}
            log.append(entry)
            try:
                if store.has(key):
                    result, entry["status"] = store.load(key), "cached"
                else:
                    made = step.run({i: state[i] for i in step.inputs})
                    if not isinstance(made, Mapping):
                        raise TypeError(f"step {step.name!r} must return a mapping, not {type(made).__name__}")
                    if missing := [o for o in step.outputs if o not in made]:
                        raise ValueError(f"step {step.name!r} did not make {', '.join(missing)}")
                    result = store.save(key, step, inputs, made)
                    entry["status"] = "executed"
            except Exception as e:
                entry["status"], entry["error"] = "failed", f"{type(e).__name__}: {e}"
                raise
            finally:
                entry["end_time"] = time.time()
            state |= result
            hashes |= {o: key for o in step.outputs}
        return state
    finally:
        ok = all(e["status"] != "failed" for e in log)
        made = {o: e["hash"] for e in log if e["status"] != "failed" for o in e["outputs"]}
        summary = {"run_id": run_id, "status": "ok" if ok else "failed", "step_count": len(log), "target_outputs": list(targets), "artifacts_produced": made}
        files.write_text(store.spark, f"{store.root}/runs/{run_id}/pipeline_summary.json", json.dumps(summary, indent=2, sort_keys=True))
        files.write_text(store.spark, f"{store.root}/runs/{run_id}/step_logs.json", json.dumps(log, indent=2, sort_keys=True))


def summarize_run(root: str | Path, run_id: str, spark: SparkSession | None = None) -> dict[str, Any]:
    spark = spark or SparkSession.builder.getOrCreate()
    summary, log = (json.loads(files.read_text(spark, f"{root}/runs/{run_id}/{f}")) for f in ("pipeline_summary.json", "step_logs.json"))
    return {"run_id": summary["run_id"], "artifacts_produced": summary["artifacts_produced"], "steps_executed": [e["step"] for e in log], "failures": [e for e in log if e["status"] == "failed"]}
