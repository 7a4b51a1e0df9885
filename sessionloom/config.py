"""Settings of the evidence plans, merged from defaults, a JSON file and the environment."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Limits:
    """Bounds on evidence; 0 events means none, 0 characters means all."""

    # Fixed values
    first_events: int = 20
    last_events: int = 60
    max_errors: int = 30
    max_tool_events: int = 80
    max_compactions: int = 20
    max_user_messages: int = 40
    max_text_chars: int = 2000
    max_tool_text_chars: int = 1200

    @classmethod
    def of(cls, config: Mapping) -> Limits:
        """From settings: a value that is no number falls back to the default, a negative one to 0."""

        def number(key: str) -> int:
            try:
                return max(0, int((config.get("evidence") or {}).get(key, getattr(cls, key))))
            except (TypeError, ValueError):
                return getattr(cls, key)

        return cls(**{key: number(key) for key in cls.__dataclass_fields__})

    @property
    def user_messages(self) -> int:
        return max(1, self.max_user_messages // 2)


EVIDENCE_DEFAULTS = asdict(Limits())
DEFAULTS = {"llm": {"enabled": True, "base_url": "", "model": "", "max_input_chars": 120000}, "evidence": EVIDENCE_DEFAULTS}
#: Environment variables and the setting that each one overrides.
ENVIRONMENT = {"SESSIONLOOM_LLM_BASE_URL": "base_url", "SESSIONLOOM_LLM_MODEL": "model"}


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """`base` with the values of `over`; mappings are merged level by level."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = deep_merge(out[key], value) if both else value
    return out


def load_config(path: str | None = None, environ: Mapping[str, str] | None = None) -> dict:
    """Defaults, then the file if it is a JSON object (else a warning), then the environment."""
    out = deep_merge(DEFAULTS, {})
    if path and os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            if not isinstance(found, dict):
                raise ValueError("not an object")
            out = deep_merge(out, found)
        except (OSError, ValueError) as e:
            warnings.warn(f"settings in {path} are ignored: {e}", stacklevel=2)
    for name, key in ENVIRONMENT.items():
        if value := (os.environ if environ is None else environ).get(name):
            out = deep_merge(out, {"llm": {key: value}})
    return out


def llm_ready(config: Mapping) -> bool:
    """Is a prompt wanted: not switched off, and with an address and a model?"""
    llm = config.get("llm") or {}
    return llm.get("enabled") is not False and bool(llm.get("base_url")) and bool(llm.get("model"))
