"""Pipelines told as data: a registry of operators, composition, inherited specs."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from ..operators import cluster, crops, curve, losses, metrics, relational, series, spatial, transforms, voxel


class Registry:
    """Names to operators, in scopes; a name can be taken once."""

    def __init__(self, scope: str):
        self.scope, self._of = scope, {}

    def register(self, name: str | None = None, f: Callable | None = None):
        def add(g: Callable) -> Callable:
            key = name or g.__name__
            if key in self._of:
                raise KeyError(f"{key} is taken in {self.scope}")
            self._of[key] = g
            return g

        return add(f) if f is not None else add

    def __contains__(self, name: str) -> bool:
        return name in self._of

    def __getitem__(self, name: str) -> Callable:
        try:
            return self._of[name]
        except KeyError:
            raise KeyError(f"{self.scope} has no {name}; it has {', '.join(sorted(self._of))}") from None

    def names(self) -> list[str]:
        return sorted(self._of)

    def build(self, spec: dict) -> Callable[[DataFrame], DataFrame]:
        """``{"type": name, **parameters}`` as a function from frame to frame."""
        parameters = {k: v for k, v in spec.items() if k != "type"}
        f = self[spec["type"]]
        return lambda df: f(df, **parameters)


OPERATORS = Registry("operators")
for _module in (transforms, crops, voxel, curve, spatial, cluster, relational, series, metrics, losses):
    for _name, _f in vars(_module).items():
        if callable(_f) and not _name.startswith("_") and getattr(_f, "__module__", "") == _module.__name__ and _name not in OPERATORS:
            OPERATORS.register(_name, _f)


def compose(specs: Sequence[dict], registry: Registry = OPERATORS) -> Callable[[DataFrame], DataFrame]:
    """The operators of the specs, one after another; all names are looked up before anything runs."""
    built = [registry.build(s) for s in specs]
    return lambda df: reduce(lambda d, f: d.transform(f), built, df)


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, dictionaries by key; ``_delete_`` drops what the base has there."""
    out = {} if over.get("_delete_") else copy.deepcopy(base)
    for k, v in over.items():
        if k != "_delete_":
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else merged({}, v) if isinstance(v, dict) else copy.deepcopy(v)
    return out


def inherit(spec: dict, load: Callable[[str], dict]) -> dict:
    """A spec with its ``_base_`` specs below it; two bases may not share a key."""
    bases = spec.get("_base_", [])
    out: dict = {}
    for b in [bases] if isinstance(bases, str) else bases:
        more = inherit(load(b), load)
        if both := out.keys() & more.keys():
            raise KeyError(f"bases share {', '.join(sorted(both))}")
        out |= more
    return merged(out, {k: v for k, v in spec.items() if k != "_base_"})


def value_of(text: str) -> Any:
    """A command-line value: JSON where it is that, comma-separated values as a list, else text."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    if text.startswith("(") and text.endswith(")"):
        return tuple(value_of(x) for x in text[1:-1].split(",") if x)
    return [value_of(x) for x in text.split(",")] if "," in text else text


def overridden(spec: dict, options: dict[str, Any]) -> dict:
    """A spec with dotted keys set: ``{"data.train.loop": 2}``; numbers are places in lists."""
    out = copy.deepcopy(spec)
    for key, v in options.items():
        *path, last = key.split(".")
        at: Any = out
        for p in path:
            at = at[int(p)] if isinstance(at, list) else at.setdefault(p, {})
        if isinstance(at, list):
            at[int(last)] = v
        else:
            at[last] = v
    return out


def test_time(df: DataFrame, augmentations: Sequence[Sequence[dict]], size: float, after: Sequence[dict] = ()) -> DataFrame:
    """Each scene under every augmentation, voxelised into fragments: the rows a model is asked about, by (aug, fragment)."""
    out = None
    for i, a in enumerate(augmentations):
        from pyspark.sql import functions as F

        part = compose(after)(voxel.fragments(compose(a)(df), size)).withColumn("aug", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
