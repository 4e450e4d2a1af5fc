"""Profiles: which line program a command's output gets. Built-in ones, and trusted ones from TOML."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import tomllib
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from textkiln.operators.lines import Stage, run

log = logging.getLogger(__name__)

def _profile(drop: str | None, keep: str | None, cut: tuple[int, float, str | None], empty: str | None = None) -> list[Stage]:
    most, ratio, first = cut
    stages = [Stage("strip_ansi"), drop and Stage("regex_drop", pattern=drop), keep and Stage("regex_keep", pattern=keep)]
    stages += [Stage("smart_truncate", max_lines=most, head_ratio=ratio, priority_lines=first), empty and Stage("on_empty", fallback=empty)]
    return [s for s in stages if s]


# The built-in profiles, in the order in which commands are matched: what is dropped, what is kept, how much
# of it, and what an empty output says.
_PYTEST = _profile(r"^(platform|rootdir:|collected |plugins:)", r"(FAILED|ERROR|Exception|Traceback|==.*passed.*==)", (50, 0.2, r"(FAILED|ERROR)"), "[pytest: all passed]")
BUILT_IN: dict[str, list[Stage]] = {
    "git status": _profile(
        r"^(On branch|Your branch is up to date|nothing to commit|no changes added to commit|Changes not staged for commit:)",
        r"(modified|deleted|new file|renamed|Untracked files|error|fatal)",
        (20, 0.5, None),
        "[git status: clean]",
    ),
    "git log": _profile(None, None, (50, 1.0, None)),
    "git diff": _profile(r"^index ", None, (100, 0.5, r"^@@")),
    "cargo build": _profile(
        r"^(Compiling|Finished|Running|Updating|Downloading|Documenting|Blocking|Unblocking)",
        r"(error|warning|FAILED|test result|panicked)",
        (30, 0.3, None),
    ),
    "cargo test": _profile(
        r"^(Compiling|Finished|Running|Updating|Downloading|Documenting)",
        r"(test result:|FAILED|error|warning|panicked)",
        (50, 0.3, r"(test result:|FAILED)"),
        "[cargo test: all passed]",
    ),
    "pytest": _PYTEST,
    "python -m pytest": _PYTEST,
    "npm test": _profile(r"^(> |PASS |Test Suites:|Tests:|Snapshots:|Time:)", r"(FAIL|error|failed|Error:)", (50, 0.2, r"FAIL"), "[npm test: all passed]"),
    "ls -la": _profile(None, None, (100, 0.5, None)),
    "tree": _profile(None, None, (100, 0.5, None)),
}
DEFAULT = [Stage("strip_ansi")]


class TrustStore:
    """Files whose present content was declared trustworthy."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def _known(self) -> dict[str, str]:
        try:
            known = json.loads(self.path.read_text())
            return known if isinstance(known, dict) else {}
        except (OSError, ValueError):
            return {}

    def trust(self, file: str) -> None:
        known = self._known() | {os.path.abspath(file): hashlib.sha256(Path(file).read_bytes()).hexdigest()}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(known))
        os.replace(new, self.path)

    def trusts(self, file: str) -> bool:
        return self._known().get(os.path.abspath(file)) == hashlib.sha256(Path(file).read_bytes()).hexdigest()


def load_toml(file: str, store: TrustStore) -> dict[str, list[Stage]]:
    """Profiles of a trusted file, by command prefix; a missing file has none."""
    if not Path(file).exists():
        return {}
    if not store.trusts(file):
        raise ValueError(f"{file} is NOT trusted")
    try:
        tables = tomllib.loads(Path(file).read_text())
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"Failed to parse TOML: {e}") from e
    out: dict[str, list[Stage]] = {}
    for name, t in tables.get("filter", {}).items():
        try:
            out[t.get("command", name)] = [Stage.of(s) for s in t.get("stages", [])]
        except (TypeError, ValueError, AttributeError, KeyError) as e:
            log.warning("profile %s left out: %s", name, e)
    return out


def resolve(command: Column, user: dict[str, list[Stage]] | None = None) -> Column:
    """The first profile whose name the command starts with, user profiles first; null if none."""
    out = None
    for k in [*(user or {}), *BUILT_IN]:
        hit = command.startswith(k)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def apply(command: Column, text: Column, user: dict[str, list[Stage]] | None = None) -> Column:
    """The text after the program of the command's profile. Only the branch that fits is evaluated."""
    programs = [*(user or {}).items(), *BUILT_IN.items()]
    out = None
    for k, stages in programs:
        hit, value = command.startswith(k), run(text, stages)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(run(text, DEFAULT))
