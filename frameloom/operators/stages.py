"""Composition of transformations: declared stages, transforms of columns, and objects made from configuration."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame

Transform = Callable[[DataFrame], DataFrame]


def apply_all(df: DataFrame, functions: list[Transform]) -> DataFrame:
    """The functions in turn."""
    return reduce(lambda d, f: f(d), functions, df)


def on_columns(targets: list[str], f: Callable[[Column], Column]) -> Transform:
    """A transformation that replaces each target column by f of it; a missing one is an error."""

    def apply(df: DataFrame) -> DataFrame:
        missing = [c for c in targets if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {missing} among {df.columns}")
        return df.withColumns({c: f(df[c]) for c in targets})

    return apply


@dataclass(frozen=True)
class Stage:
    """A transformation that names the columns it reads and those it adds."""

    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Transform


def run_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Runs stages in order; each one's declared inputs must be there before it and its outputs after it."""
    for stage in stages:
        if missing := [c for c in stage.inputs if c not in df.columns]:
            raise ValueError(f"stage {stage.name} lacks {missing}")
        df = stage.run(df)
        if missing := [c for c in stage.outputs if c not in df.columns]:
            raise ValueError(f"stage {stage.name} did not add {missing}")
    return df


def instantiate(config: Mapping[str, Any], **more: Any) -> Any:
    """Calls what the dotted path under ``target`` names with ``params``."""
    if "target" not in config:
        raise KeyError("the configuration names no target")
    module, _, name = config["target"].rpartition(".")
    return getattr(importlib.import_module(module), name)(**config.get("params", {}), **more)


class Registry:
    """Builders by name, as a dataset's name in a configuration picks its source."""

    def __init__(self):
        self.builders: dict[str, Callable] = {}

    def add(self, name: str):
        def register(f: Callable) -> Callable:
            self.builders[name.lower()] = f
            return f

        return register

    def build(self, name: str, *args: Any, **options: Any) -> Any:
        if name.lower() not in self.builders:
            raise KeyError(f"{name} is none of {sorted(self.builders)}")
        return self.builders[name.lower()](*args, **options)
