"""Versioned prompt files: <folder>/<name>/v<N>.txt."""

from __future__ import annotations

import json
import re
from pathlib import Path


def load_prompt(folder: str | Path, name: str, version: str = "latest") -> tuple[str, str]:
    """(text, version) of a prompt; `latest` is the numerically largest version."""
    files = {p.stem: p for p in (Path(folder) / name).glob("v*.txt") if re.fullmatch(r"v\d+", p.stem)}
    if not files:
        raise FileNotFoundError(f"no versions of prompt {name} in {folder}")
    chosen = max(files, key=lambda v: int(v[1:])) if version == "latest" else version
    if chosen not in files:
        raise FileNotFoundError(f"prompt {name} has no version {version}")
    return files[chosen].read_text(encoding="utf-8"), chosen


def wrap_json(prompt: str, data: str) -> str:
    """A prompt followed by JSON input and a closing fence, which the prompt's text opens. ValueError for other input."""
    try:
        json.loads(data)
    except ValueError as e:
        raise ValueError("the input is not JSON") from e
    return f"{prompt}\n{data}\n```"
