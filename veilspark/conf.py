"""Settings: defaults, overlaid by files' contents, a run's state and the environment. All of it lives on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:  # then only layers given as mappings count
    yaml = None


@dataclass(frozen=True)
class EngineConf:
    chunk_size: int = 1600
    chunk_overlap: int = 200
    #: None: all chunks of a document; 1: the first only.
    max_chunks_per_doc: int | None = None
    min_agreement: int = 1
    min_agreement_names: int = 1
    min_score: float = 0.0
    zero_shot_threshold: float = 0.28
    recogniser_threshold: float = 0.35
    slm_threshold: float = 0.0
    judge_low_agreement: bool = True
    judge_batch: int = 8
    timeout_seconds: int = 3600
    llm_mode: str = "local"
    latest_report: str | None = None
    updated_at: str | None = None

    @classmethod
    def load(cls, *layers: Mapping[str, Any], env: Mapping[str, str] | None = None) -> EngineConf:
        """Later layers win; ``VEILSPARK_<FIELD>`` of the environment wins over all. Unknown names are left out."""
        merged: dict[str, Any] = {}
        for layer in layers:
            merged = deep_merge(merged, layer)
        env = os.environ if env is None else env
        known = {f.name: f for f in fields(cls)}
        values = {k: v for k, v in merged.items() if k in known}
        for name in known:
            if (raw := env.get(f"VEILSPARK_{name.upper()}", "").strip()) != "":
                values[name] = _typed(raw, getattr(cls, name))
        made = replace(cls(), **values)
        return replace(made, llm_mode=normalise_mode(made.llm_mode), timeout_seconds=max(60, int(made.timeout_seconds)))

    @classmethod
    def read(cls, *paths: str, state: str | None = None, env: Mapping[str, str] | None = None) -> EngineConf:
        """The settings of YAML files, later ones over earlier ones, the report that ``state`` names last, and the environment over all."""
        last = {k: v for k, v in read_yaml(state).items() if k in ("latest_report", "updated_at") and v is not None} if state else {}
        return cls.load(*(read_yaml(p) for p in paths), last, env=env)

    def snapshot(self) -> dict[str, Any]:
        return asdict(self)


def read_yaml(path: str) -> dict[str, Any]:
    """A YAML file's mapping; nothing where there is no such file, or it is anything else."""
    if yaml is None or not Path(path).is_file():
        return {}
    try:
        found = yaml.safe_load(Path(path).read_text("utf-8"))
    except (yaml.YAMLError, UnicodeDecodeError):
        return {}
    return found if isinstance(found, dict) else {}


def write_state(path: str, latest_report: str, updated_at: str) -> None:
    """Note the latest report in a YAML file that ``read`` takes as its state; whatever else the file has stays."""
    if yaml is None:
        raise RuntimeError("a state file needs PyYAML")
    made = read_yaml(path) | {"latest_report": latest_report, "updated_at": updated_at}
    part = Path(path + ".part")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(yaml.safe_dump(made, allow_unicode=True, sort_keys=False), "utf-8")
    part.replace(path)


def _typed(raw: str, like: Any) -> Any:
    if isinstance(like, bool):
        return raw.lower() in ("1", "true", "yes", "y")
    if like is None:
        return int(raw) if raw.lstrip("-").isdigit() else raw
    return type(like)(raw)


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Mappings merged key by key, at every depth; anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
        out[k] = deep_merge(out[k], v) if both else v
    return out


def normalise_mode(mode: str | None) -> str:
    """``cpu``, ``gpu`` or ``local``, whatever the case; anything else is local."""
    mode = (mode or "").strip().lower()
    return mode if mode in ("cpu", "gpu") else "local"


def slm_source(mode: str) -> str:
    """The name under which the small model votes."""
    return "qwen_cpu" if normalise_mode(mode) == "cpu" else "qwen"
