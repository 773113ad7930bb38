"""Settings: files, environment, and their order of precedence."""

from __future__ import annotations

import os
from pathlib import Path

import yaml

from ..plans.rubric import Rubric, Scale, rubric_from


def load(path: str | Path) -> dict:
    """A settings file; absent is empty."""
    p = Path(path)
    return (yaml.safe_load(p.read_text(encoding="utf-8")) or {}) if p.exists() else {}


def rubric(path: str | Path) -> Rubric:
    return rubric_from(load(path))


def save_rubric(config: dict, path: str | Path) -> bool:
    """Write a generated rubric, if it has dimensions."""
    if not config.get("dimensions"):
        return False
    Path(path).write_text(yaml.safe_dump(config, allow_unicode=True, sort_keys=False), encoding="utf-8")
    return True


def environment(path: str | Path | None = None) -> dict[str, str]:
    """KEY=value lines of a file, under those of the process."""
    found = {}
    if path and Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("\"'")
    return found | dict(os.environ)


def providers(env: dict[str, str], prefix: str = "LLM", most: int = 5) -> list[dict[str, str]]:
    """The graders whose url, key and model are all set: plain, then numbered from 2."""
    found = []
    for suffix in ("", *(f"_{n}" for n in range(2, most + 1))):
        one = {k: env.get(f"{prefix}_{name}{suffix}", "") for k, name in (("url", "API_URL"), ("key", "API_KEY"), ("model", "MODEL"))}
        if all(one.values()):
            found.append(one)
    return found


def scale(arguments: dict, env: dict[str, str], settings: dict) -> Scale:
    """Arguments before environment before file before default; an explicit zero counts."""
    ranged = settings.get("score_range", {})
    pick = lambda arg, var, key, default: next(float(x) for x in (arguments.get(arg), env.get(var) or None, ranged.get(key), default) if x is not None)
    return Scale(low=pick("score_min", "SCORE_MIN", "min", 0), high=pick("score_max", "SCORE_MAX", "max", 100))


def prompt(folder: str | Path, name: str, default: str) -> str:
    """A prompt file, .md before .txt, else the default."""
    for kind in (".md", ".txt"):
        p = Path(folder) / f"{name}{kind}"
        if p.exists():
            return p.read_text(encoding="utf-8")
    return default


def filled(template: str, values: dict[str, str]) -> str:
    """The template with each {name} of `values` replaced; other braces stay."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", value)
    return template
