"""Versions, devices and the options file, resolved on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

DEFAULTS = {"device": "auto", "num_threads": 0, "ko": {"vowel_length": False, "to_ipa": False, "to_ssml": False, "tn_only": False}, "ja": {"script": "katakana", "pitch_accent": False, "to_ipa": False, "to_ssml": False, "tn_only": False}, "en": {"to_ipa": False, "to_ssml": False, "tn_only": False}}


def version_number(version: str) -> int:
    major, minor, patch = map(int, version.split("."))
    return major * 10000 + minor * 100 + patch


def compatible(version: str, major: int, minor: int) -> bool:
    """Same major version, and at least the minor version asked for."""
    own = list(map(int, version.split(".")))
    return own[0] == major and own[1] >= minor


def resolve_device(explicit: str | None, config: Mapping, env: Mapping | None = None) -> str:
    env = os.environ if env is None else env
    return explicit or env.get("VOXWEAVE_DEVICE") or config.get("device") or "auto"


def load_or_default(path: str | None = None) -> dict:
    """The options file over the defaults; the defaults alone if it is missing."""
    own = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    return {k: {**v, **own.get(k, {})} if isinstance(v, dict) else own.get(k, v) for k, v in DEFAULTS.items()}
