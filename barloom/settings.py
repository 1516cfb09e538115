"""Settings from the environment and from a file of NAME=VALUE lines; the environment wins. Loggers."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass
from pathlib import Path

PREFIX = "BARLOOM_"


def read_env_file(path: str | Path = ".env") -> dict[str, str]:
    """NAME=VALUE lines; blank lines and those that start with # are skipped, quotes around a value go."""
    file = Path(path)
    pairs = {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.is_file() else []:
        name, found, value = line.strip().partition("=")
        if found and name and not name.startswith("#"):
            pairs[name.strip()] = value.strip().strip("\"'")
    return pairs


@dataclass(frozen=True)
class Settings:
    """Where bars are stored, how times are shown, how much is logged, where klines come from."""

    store: str = "bars"
    display_tz: str = "UTC"
    log_level: str = "INFO"
    klines_url: str = ""

    @classmethod
    def load(cls, env_file: str | Path = ".env", environ: dict[str, str] | None = None) -> Settings:
        known = read_env_file(env_file) | dict(os.environ if environ is None else environ)
        return cls(**{f: known[PREFIX + f.upper()] for f in cls.__dataclass_fields__ if known.get(PREFIX + f.upper())})


def get_logger(name: str, level: str | None = None) -> logging.Logger:
    """A logger that writes to stderr once, at the level of the settings."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel((level or Settings.load().log_level).upper())
    return log
