"""Settings, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass


def last_component(path: str, default: str) -> str:
    """The directory's own name; ``default`` if the path names none."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    return parts[-1] if parts and parts[-1] != ".." else default


@dataclass
class ScanConfig:
    root: str = "."
    app_path: str = ""
    shared_dir: str = "shared"
    shared_2023_dir: str = "shared_2023"
    models_subdir: str = "models"

    @property
    def shared_name(self) -> str:
        return last_component(self.shared_dir, "shared")

    @property
    def shared_2023_name(self) -> str:
        return last_component(self.shared_2023_dir, "shared_2023")


@dataclass
class WatchConfig:
    debounce_ms: int = 100


@dataclass
class Config:
    scan: ScanConfig = field(default_factory=ScanConfig)
    watch: WatchConfig = field(default_factory=WatchConfig)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Missing fields keep their defaults; unknown ones are left aside."""
        return _filled(cls(), json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def _filled(obj, given: dict):
    for f in fields(obj):
        if f.name in given:
            now = getattr(obj, f.name)
            setattr(obj, f.name, _filled(now, given[f.name]) if is_dataclass(now) else given[f.name])
    return obj
