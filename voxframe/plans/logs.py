"""Console and file logging of a run on the driver."""

from __future__ import annotations

import logging
from pathlib import Path

from voxframe.sources.config import RunConfig


class _Context(logging.Filter):
    """Gives records without them a run and a step."""

    def __init__(self, run_id: str):
        super().__init__()
        self.run_id = run_id

    def filter(self, record: logging.LogRecord) -> bool:
        record.run_id = getattr(record, "run_id", self.run_id)
        record.step = getattr(record, "step", "-")
        return True


def configure(config: RunConfig, run_id: str, console: int = logging.INFO, file: int = logging.DEBUG) -> logging.Logger:
    """The run's logger: short lines on the console, run_<id>.log in the log folder. A second call replaces the first."""
    Path(config.log_dir).mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger("voxframe")
    for old in list(logger.handlers):
        old.close()
    logger.handlers, logger.filters, logger.propagate = [], [_Context(run_id)], False
    logger.setLevel(logging.DEBUG)
    screen, book = logging.StreamHandler(), logging.FileHandler(Path(config.log_dir) / f"run_{run_id}.log", encoding="utf-8")
    screen.setLevel(console)
    screen.setFormatter(logging.Formatter("[%(levelname)s] %(message)s"))
    book.setLevel(file)
    book.setFormatter(logging.Formatter("%(asctime)s | run=%(run_id)s | step=%(step)s | %(levelname)s | %(message)s", "%Y-%m-%dT%H:%M:%S"))
    logger.handlers = [screen, book]
    return logger
