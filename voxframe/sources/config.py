"""Configuration files: the first of config.yaml and voxframe.yaml; sections of plain keys, as they need no YAML library."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

FILES = ("config.yaml", "voxframe.yaml")


class ConfigError(ValueError):
    pass


def parse(text: str) -> dict[str, Any]:
    """``key: value`` lines, and ``key:`` lines with indented ones below; ``#`` begins a comment."""
    out: dict[str, Any] = {}
    section: dict[str, str] | None = None
    for line in (raw.split("#", 1)[0].rstrip() for raw in text.splitlines()):
        key, colon, value = (part.strip() for part in line.partition(":"))
        if not colon:
            continue
        value = value.strip("\"'")
        if line[0] == " ":
            if section is not None:
                section[key] = value
        elif value:
            out[key], section = value, None
        else:
            out[key] = section = {}
    return out


def load(root: str | Path) -> dict[str, Any]:
    found = next((p for p in (Path(root) / f for f in FILES) if p.exists()), None)
    return parse(found.read_text()) if found else {}


def out_dir(config: dict[str, Any], given: str | Path | None = None) -> str:
    """What was given, or paths.out_dir, or io.out_dir: a path or URI of any file system."""
    if given is not None:
        return str(given)
    for section in ("paths", "io"):
        held = config.get(section)
        if isinstance(held, dict) and held.get("out_dir", "").strip():
            return held["out_dir"].strip()
    raise ConfigError("no output folder: give one, or set paths.out_dir in config.yaml")


@dataclass(frozen=True)
class RunConfig:
    mode: str = "run"  # or "debug": the first failure is raised
    log_dir: Path = Path("logs")
    write_events: bool = True
    max_failures: int | None = None
    prefix: str = field(default="", repr=False)

    def from_env(self, env: dict[str, str] | None = None) -> RunConfig:
        """With what <prefix>ERROR_MODE, LOG_DIR, WRITE_JSONL and MAX_FAILURES say; what makes no sense is left."""
        env = dict(os.environ) if env is None else env
        get = lambda name, default: env.get(self.prefix + name, default).strip()
        mode, limit = get("ERROR_MODE", self.mode).lower(), get("MAX_FAILURES", "")
        return replace(
            self,
            mode=mode if mode in ("run", "debug") else self.mode,
            log_dir=Path(get("LOG_DIR", str(self.log_dir))),
            write_events=get("WRITE_JSONL", "1" if self.write_events else "0").lower() not in ("0", "false", ""),
            max_failures=int(limit) if limit.lstrip("-").isdigit() else self.max_failures,
        )
