"""Pruning settings from a file of lines like ``VARIABLE = "VALUE"``; ``#`` begins a comment."""

from __future__ import annotations

import os
import re
from dataclasses import replace

from pathweave.operators.prune import PruneConfig

_LINE = re.compile(r'\s*(?:([A-Z_a-z][A-Z_a-z0-9]*)\s*=\s*"([^"\n]*)")?\s*(?:#.*)?')
_NAMES = {"PRUNE_BIND_MOUNTS": "bind_mounts", "PRUNEFS": "fs", "PRUNENAMES": "names", "PRUNEPATHS": "paths"}


class ConfigError(ValueError):
    pass


def parse_flag(text: str) -> bool:
    if text in ("1", "yes"):
        return True
    if text in ("0", "no"):
        return False
    raise ConfigError(f"{text!r} is neither yes nor no")


def parse(text: str) -> PruneConfig:
    found: dict[str, object] = {}
    for number, line in enumerate(text.split("\n"), 1):
        m = _LINE.fullmatch(line)
        if not m:
            raise ConfigError(f"line {number} can't be read: {line!r}")
        if not m[1]:
            continue
        if m[1] not in _NAMES:
            raise ConfigError(f"line {number}: unknown variable {m[1]}")
        name = _NAMES[m[1]]
        if name in found:
            raise ConfigError(f"line {number}: {m[1]} is set before")
        found[name] = parse_flag(m[2]) if name == "bind_mounts" else tuple(m[2].split())
    return PruneConfig(**found)


def load(path: str) -> PruneConfig:
    """The settings in a file; a file that isn't there sets nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except FileNotFoundError:
        return PruneConfig()


def override(config: PruneConfig, lists: dict[str, str] | None = None, added: dict[str, list[str]] | None = None, single_paths: list[str] | None = None, bind_mounts: str | None = None) -> PruneConfig:
    """``lists`` replace a list as a whole; ``added`` names and ``single_paths`` (which may have spaces) are added."""
    out = config
    for name, text in (lists or {}).items():
        out = replace(out, **{name: tuple(text.split())})
    for name, values in (added or {}).items():
        out = replace(out, **{name: (*getattr(out, name), *[w for v in values for w in v.split()])})
    if single_paths:
        out = replace(out, paths=(*out.paths, *single_paths))
    return out if bind_mounts is None else replace(out, bind_mounts=parse_flag(bind_mounts))


def canonical(path: str) -> str:
    return os.path.realpath(path)
