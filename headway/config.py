"""Settings with defaults, overridden by environment variables or by ``spark.conf`` under ``spark.headway.``."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

_YES, _NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


class ConfigError(ValueError):
    """A setting that can't be read as what it should be."""


def _read(name: str, raw: str, default: Any) -> Any:
    """``raw`` as the kind of thing that ``default`` is."""
    raw = raw.strip()
    if isinstance(default, bool):
        if raw.lower() not in _YES + _NO:
            raise ConfigError(f"{name} is {raw!r}; it must be one of {', '.join(_YES + _NO)}")
        return raw.lower() in _YES
    if isinstance(default, (int, float)):
        try:
            return type(default)(raw)
        except ValueError as e:
            raise ConfigError(f"{name} is {raw!r}; it must be a number") from e
    if isinstance(default, tuple):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    return raw


@dataclass(frozen=True)
class Settings:
    """What collection and modelling run with; every one has a fixed default."""

    lines: tuple[str, ...] = ("T1", "T4")
    sink: str = "parquet"
    poll_seconds: int = 120
    alerts_every: int = 15
    burst_polls: int = 5
    burst_spacing_seconds: int = 90
    stops_kept: int = 3
    need_routes: bool = False
    window_seconds: int = 900
    late_seconds: float = 300
    late_share: float = 0.25
    least_services: int = 5
    horizon_windows: int = 2
    history_windows: int = 3

    def __post_init__(self):
        if self.sink not in ("parquet", "csv"):
            raise ConfigError(f"sink is {self.sink!r}; it must be parquet or csv")
        if self.poll_seconds < 1:
            raise ConfigError("poll_seconds must be at least 1")

    @property
    def trigger(self) -> str:
        return f"{self.poll_seconds} seconds"

    @property
    def alerts_trigger(self) -> str | None:
        """The alerts' own clock; none if they are never polled."""
        return f"{self.poll_seconds * self.alerts_every} seconds" if self.alerts_every > 0 else None


def settings(spark=None, environ: Mapping[str, str] | None = None, prefix: str = "HEADWAY_") -> Settings:  # noqa: ANN001
    """Defaults, then ``HEADWAY_<NAME>`` variables, then ``spark.headway.<name>``; an empty value counts as none."""
    environ = os.environ if environ is None else environ
    out = Settings()
    for f in fields(Settings):
        raw = environ.get(prefix + f.name.upper(), "")
        if spark is not None:
            raw = spark.conf.get(f"spark.headway.{f.name}", "") or raw
        if raw.strip():
            out = replace(out, **{f.name: _read(f.name, raw, getattr(Settings, f.name))})
    return out
