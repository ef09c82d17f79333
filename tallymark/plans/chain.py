"""Transform chains over a source/target pair."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tallymark.operators import transforms as t

Transform = Callable[..., DataFrame]

TRANSFORMS: dict[str, Transform] = {
    "rename_columns": t.rename_columns,
    "filter_rows": t.filter_rows,
    "cast_columns": t.cast_columns,
    "explode_arrays": t.explode_arrays,
    "flatten_structs": t.flatten_structs,
    "decode_codes": t.decode_codes,
    "add_constant": t.add_constant,
    "keep_value": t.keep_value,
    "upper_column": t.upper_column,
    "group_aggregate": t.group_aggregate,
}


def register(name: str, transform: Transform) -> None:
    """Make a user's ``DataFrame -> DataFrame`` function usable by name in a chain."""
    TRANSFORMS[name] = transform


@dataclass(frozen=True)
class Step:
    """One step: a registered name or a function, its arguments, and the side it applies to.

    The name ``align_types`` is special: it casts the target to the source's types.
    """

    transform: str | Transform
    params: Mapping[str, Any] = field(default_factory=dict)
    side: str = "both"


@dataclass(frozen=True)
class ChainResult:
    source: DataFrame
    target: DataFrame
    steps: list[dict[str, str]]


def run_chain(source: DataFrame, target: DataFrame, steps: Sequence[Step]) -> ChainResult:
    """Apply the steps in order, each side from its own data.

    A step that fails while its plan is built is recorded with status ``error`` and skipped; the
    steps after it still run. Nothing is executed here.
    """
    log: list[dict[str, str]] = []
    for step in steps:
        name = step.transform if isinstance(step.transform, str) else step.transform.__name__
        try:
            if step.side not in ("source", "target", "both"):
                raise ValueError(f"unknown side '{step.side}'")
            if name == "align_types":
                new_source, new_target = source, t.align_types(source, target)
            else:
                function = TRANSFORMS[step.transform] if isinstance(step.transform, str) else step.transform
                new_source = source.transform(function, **step.params) if step.side != "target" else source
                new_target = target.transform(function, **step.params) if step.side != "source" else target
        except Exception as error:  # a user's transform may raise anything
            log.append({"step": name, "side": step.side, "status": "error", "message": str(error)})
            continue
        source, target = new_source, new_target
        log.append({"step": name, "side": step.side, "status": "success", "message": ""})
    return ChainResult(source, target, log)
