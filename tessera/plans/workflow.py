"""Workflows: named lists of steps over one DataFrame, from a YAML file.

A step is a name, one name with options, or ``exec`` with a shell command; every step is checked before the first
one runs.  Steps are chained lazily, so the optimizer sees the whole workflow; nothing runs before a sink or
an ``exec``.  That one gets the rows so far as a Parquet table, named in its environment, and the steps after it go
on from that table.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import written
from . import commands

Step = Callable[..., DataFrame]

#: Names an option may have in a file -> parameter.
ALIASES = {"from": "bucket"}
#: The variable of a command's environment that names the table of the rows so far.
TABLE_VARIABLE = "TESSERA_TABLE"


class ConfigError(ValueError):
    """A workflow that cannot be run as written."""


def _bucket(df: DataFrame, bucket: str | None) -> DataFrame:
    return df if bucket is None else df.where(F.col("bucket").isin([b.strip() for b in bucket.split(",")]))


def _step(command: Step) -> Step:
    return lambda df, bucket=None, **options: command(_bucket(df, bucket), **options)


#: ``search`` starts from terms, not from rows, so it is no step.
STEPS: dict[str, Step] = {
    name: _step(getattr(commands, name))
    for name in (
        "analyze", "annotate", "augment", "cluster", "dedup", "detect", "extract_classes", "extract_faces",
        "extract_frames", "fetch", "format", "frame", "rename", "select", "upscale", "validate",
    )
}


def _config(text: str) -> dict:
    config = yaml.safe_load(text) or {}
    if not isinstance(config, dict):
        raise ConfigError("not a mapping")
    return config


def load(text: str, name: str, steps: dict[str, Step] = STEPS) -> list[tuple[str, dict]]:
    """The steps of a workflow with their options.

    Defaults come from the file's section of the step's name, unless the step says ``inherit: false``.
    """
    config = _config(text)
    workflows = config.get("workflows")
    if not isinstance(workflows, dict) or name not in workflows:
        raise ConfigError(f"no workflow {name!r}")
    if not isinstance(workflows[name], list) or not workflows[name]:
        raise ConfigError(f"workflow {name!r} has no steps")
    out = []
    for item in workflows[name]:
        if isinstance(item, str):
            step, options = item, {}
        elif isinstance(item, dict) and len(item) == 1:
            step, options = next(iter(item.items()))
            options = options or {}
        else:
            raise ConfigError(f"not a step: {item!r}")
        if step == "exec":
            if not isinstance(options, str) or not options.strip():
                raise ConfigError("exec needs a command")
            out.append((step, {"command": options.strip()}))
            continue
        step = step.replace("-", "_")
        if step not in steps:
            raise ConfigError(f"unknown step {step!r}")
        if not isinstance(options, dict):
            raise ConfigError(f"options of {step!r} are no mapping")
        options = dict(options)
        inherit = options.pop("inherit", True)
        if not isinstance(inherit, bool):
            raise ConfigError(f"inherit of {step!r} is true or false")
        merged = (dict(config.get(step) or config.get(step.replace("_", "-")) or {}) if inherit else {}) | options
        out.append((step, {ALIASES.get(k, k).replace("-", "_"): v for k, v in merged.items()}))
    return out


def plan(text: str, name: str, steps: dict[str, Step] = STEPS) -> list[str]:
    """What a workflow would do, a line a step; nothing runs."""
    lines = []
    for step, options in load(text, name, steps):
        lines.append(f"exec {options['command']}" if step == "exec" else " ".join([step, *(f"{k}={v!r}" for k, v in options.items())]))
    return lines


def working_dir(text: str, base: str = ".") -> str:
    """The file's ``working_dir``, relative to the folder of the file."""
    return os.path.join(base, str(_config(text).get("working_dir") or "."))


def _execute(df: DataFrame, command: str, folder: str) -> DataFrame:
    table = written(df, "exec")
    (path,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()} or {""}
    done = subprocess.run(command, shell=True, cwd=folder, env=os.environ | {TABLE_VARIABLE: path})
    if done.returncode:
        raise commands.PipelineError(f"exit code {done.returncode} of {command!r}")
    return table


def run(df: DataFrame, text: str, name: str, steps: dict[str, Step] = STEPS, base: str = ".") -> DataFrame:
    """The rows after the last step; ``exec`` commands run on the driver, in `working_dir`, when their turn comes."""
    for step, options in load(text, name, steps):
        df = _execute(df, options["command"], working_dir(text, base)) if step == "exec" else steps[step](df, **options)
    return df
