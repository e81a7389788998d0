"""Recognisers for transcript.transcribe(): plug-ins named "module:function", and the Whisper library where it is installed."""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np

RATE = 16_000
MODELS = ("tiny", "base", "small", "medium", "large")


def named(spec: str) -> Callable[[], Callable[[dict], list[tuple[float, float, str]]]]:
    """The backend that "module:function" names: a function without arguments that gives a recogniser."""
    module, colon, name = spec.partition(":")
    if not colon:
        raise ValueError(f"a recogniser is named module:function, not {spec!r}")
    return getattr(importlib.import_module(module), name)


def echo() -> Callable[[dict], list[tuple[float, float, str]]]:
    """A backend that needs no model: each window's speaker and channel over the whole window."""
    spelled = lambda channel: "" if channel is None or np.isnan(channel) else str(int(channel))
    return lambda chunk: [(0.0, chunk["end_time"] - chunk["start_time"], f"{chunk['label']}{spelled(chunk.get('channel'))}")]


def to_rate(samples: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Samples at another rate, linearly, one at least."""
    if rate <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    if rate == target or not len(samples):
        return samples
    n = max(1, round(len(samples) * target / rate))
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(samples)), samples)


def stretch(samples: np.ndarray, rate: int, start_s: float, end_s: float) -> np.ndarray:
    """The samples between two times, rounded to whole samples, clamped to the recording."""
    a = min(max(round(start_s * rate), 0), len(samples))
    return samples[a : min(max(round(end_s * rate), a), len(samples))]


@dataclass(frozen=True)
class Whisper:
    """A backend on the Whisper library. chunks need columns rec, a path that the worker can open, and channel (null: the mean
    of all). Called once a task, so a worker loads one model."""

    model: str = "base"
    model_path: str | None = None
    model_dir: str | None = None
    language: str | None = None

    def checkpoint(self) -> Path:
        """Where the model's file is expected."""
        if self.model_path or os.environ.get("WHISPER_MODEL_PATH"):
            return Path(self.model_path or os.environ["WHISPER_MODEL_PATH"])
        folder = self.model_dir or os.environ.get("WHISPER_MODEL_DIR") or Path.home() / ".cache" / "whisper"
        return Path(folder) / f"{self.model}.pt"

    def status(self) -> dict[str, str]:
        ready = self.checkpoint().exists()
        installed = importlib.util.find_spec("whisper") is not None
        step = "" if ready and installed else "install the whisper library" if ready else f"place the checkpoint at {self.checkpoint()}"
        return {"model": self.model, "expected_checkpoint": str(self.checkpoint()), "language": self.language or "auto", "exists": "yes" if ready else "no", "library": "yes" if installed else "no", "next_step": step}

    def __call__(self) -> Callable[[dict], list[tuple[float, float, str]]]:
        import whisper  # only where that library is installed

        model = whisper.load_model(str(self.checkpoint()) if self.checkpoint().exists() else self.model)

        def recognise(chunk: dict) -> list[tuple[float, float, str]]:
            from voxframe.sources.audio import decode_wav

            rate, samples = decode_wav(Path(chunk["rec"].removeprefix("file:")).read_bytes())
            channel = chunk.get("channel")
            mono = samples.mean(1) if channel is None or np.isnan(channel) else samples[:, int(channel)]
            own = to_rate(stretch(mono, rate, chunk["start_time"], chunk["end_time"]), rate)
            if not len(own):
                return []
            heard = model.transcribe(own.astype(np.float32), language=self.language)
            return [(float(s["start"]), float(s["end"]), s["text"]) for s in heard["segments"]]

        return recognise
