"""Run configuration: strict settings with dotted overrides, file grouping and run naming."""

from __future__ import annotations

import copy
import heapq
import json


def load(text: str, allowed: dict) -> dict:
    """Settings of a JSON text over the defaults ``allowed``; unknown keys raise."""
    return _over(allowed, json.loads(text), "")


def _over(base: dict, new: dict, at: str) -> dict:
    out = copy.deepcopy(base)
    for k, v in new.items():
        if k not in base:
            raise KeyError(f"unknown setting {at}{k}")
        out[k] = _over(base[k], v, f"{at}{k}.") if isinstance(base[k], dict) and isinstance(v, dict) else v
    return out


def override(settings: dict, assignment: str) -> dict:
    """``a.b=value`` put over the settings, as the type of what is there."""
    path, equals, text = assignment.partition("=")
    if not equals:
        raise ValueError(f"{assignment!r} has no =")
    out = copy.deepcopy(settings)
    *parents, name = path.split(".")
    here = out
    for p in parents:
        here = here[p]
    if name not in here:
        raise KeyError(f"unknown setting {path}")
    old = here[name]
    if isinstance(old, bool):
        if text.lower() not in ("true", "false"):
            raise ValueError(f"{path} is true or false")
        here[name] = text.lower() == "true"
    elif isinstance(old, (int, float)):
        here[name] = type(old)(text)
    elif isinstance(old, (list, dict)):
        here[name] = json.loads(text)
    else:
        here[name] = text
    return out


def group_by_size(sizes: dict[str, int], groups: int) -> list[list[str]]:
    """Files dealt to groups of about equal size: largest first, each to the lightest group."""
    heap = [(0, k) for k in range(groups)]
    out: list[list[str]] = [[] for _ in range(groups)]
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        weight, k = heapq.heappop(heap)
        out[k].append(name)
        heapq.heappush(heap, (weight + size, k))
    return out


def unique_name(wanted: str, taken: set[str]) -> str:
    """``wanted``, or with the first free number behind it."""
    if wanted not in taken:
        return wanted
    k = 2
    while f"{wanted}-{k}" in taken:
        k += 1
    return f"{wanted}-{k}"


#: Chemistry and adapter -> the kind of a run's files; the first rule that fits.
FILE_TYPES = [(("duplex", "hairpin"), "duplex"), (("duplex", None), "duplex_linear"), (("simplex", "10x"), "simplex_10x"), (("simplex", None), "simplex")]


def file_type(chemistry: str, adapter: str | None) -> str:
    """What a run's files hold, by its chemistry and adapter."""
    for (c, a), kind in FILE_TYPES:
        if c == chemistry and a in (None, adapter):
            return kind
    raise ValueError(f"no file type for {chemistry!r} with {adapter!r}")


def submit_command(script: str, settings: dict, master: str, executors: int = 0) -> list[str]:
    """The command that runs a script on a cluster with its settings as arguments."""
    return ["spark-submit", "--master", master, *(["--num-executors", str(executors)] if executors else []), script, *[f"--{k}={json.dumps(v) if isinstance(v, (dict, list)) else v}" for k, v in sorted(settings.items())]]


def sheet_rows(samples: dict[str, str]) -> list[tuple[str, str]]:
    """Rows of a sample sheet, in the samples' order."""
    return [(name, sid) for name, sid in samples.items()]


def output_name(files: list[str], part: int) -> str:
    """A part's name by what its inputs' names share at the start."""
    import os

    names = [os.path.basename(f).split(".")[0] for f in files]
    shared = os.path.commonprefix(names).rstrip("-_") or "sample"
    return f"{shared}.{part:04d}"
