"""Metrics with the columns that they need and give, run in the order of their needs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

Layers = dict[str, DataFrame]


@dataclass(frozen=True)
class Metric:
    """``compute`` takes the layers and returns ``key`` and new columns of ``layer``."""

    name: str
    layer: str
    key: str
    gives: tuple[str, ...]
    compute: Callable[[Layers], DataFrame]
    needs: tuple[str, ...] = ()  # "layer.column"


@dataclass
class Registry:
    metrics: dict[str, Metric] = field(default_factory=dict)

    def add(self, metric: Metric) -> Metric:
        if metric.name in self.metrics:
            raise ValueError(f"metric {metric.name} exists")
        self.metrics[metric.name] = metric
        return metric

    def order(self, selected: list[str] | None = None) -> list[Metric]:
        """The selected metrics and all they need, each after what it needs."""
        givers = {f"{m.layer}.{c}": m.name for m in self.metrics.values() for c in m.gives}
        needs = {n: {givers[c] for c in m.needs if c in givers} for n, m in self.metrics.items()}
        wanted, todo = set(), list(selected if selected is not None else self.metrics)
        while todo:
            if (n := todo.pop()) not in self.metrics:
                raise KeyError(f"no metric {n}")
            if n not in wanted:
                wanted.add(n)
                todo += needs[n]
        return [self.metrics[n] for n in TopologicalSorter({n: sorted(needs[n]) for n in sorted(wanted)}).static_order()]

    def run(self, layers: Layers, selected: list[str] | None = None, overwrite: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df, crash_early: bool = False) -> tuple[Layers, dict[str, float], dict[str, str]]:
        """New layers, seconds spent on each metric's plan, and errors.

        A metric whose columns all exist is skipped unless ``overwrite``; one
        that fails is reported and left out, unless ``crash_early``. ``keep``
        is called on each layer that changed (for instance to materialise it).
        """
        layers, spent, failed = dict(layers), {}, {}
        for m in self.order(selected):
            here = layers[m.layer]
            if not overwrite and all(c in here.columns for c in m.gives):
                continue
            began = time.perf_counter()
            try:
                new = m.compute(layers).select(m.key, *m.gives)
                layers[m.layer] = keep(here.drop(*m.gives).join(new, m.key, "left"))
            except Exception as e:
                if crash_early:
                    raise
                failed[m.name] = str(e)
            spent[m.name] = time.perf_counter() - began
        return layers, spent, failed
