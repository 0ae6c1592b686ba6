"""What an observer is: how it turns transitions into deltas, deltas into rows at labels, and rows into files."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.snapshots import path_deltas, totals, totals_at


class Observer(ABC):
    """A view over the transitions. Subclasses give at(); those with files give write(), those that verify give compare()."""

    def __init__(self, name: str):
        self.name = name

    @abstractmethod
    def at(self, transitions: DataFrame, labels: Sequence) -> DataFrame:
        """snap and the view's rows at each label."""

    def write(self, rows: DataFrame, where: str, stamp: str) -> None:
        """Files of one label's rows; nothing by default."""

    def compare(self, mine: DataFrame, truth: DataFrame) -> DataFrame | None:
        """Differences of one label's rows from the true ones; None if the view is not verified."""
        return None


class DeltaObserver(Observer):
    """An observer that sums the signed contributions of paths: subclasses say which rows a path contributes to.

    contribution(deltas) maps rc, peer_ip, fam, file_label, path, d to any keys, file_label and d.
    """

    keys: tuple[str, ...] = ()

    @abstractmethod
    def contribution(self, deltas: DataFrame) -> DataFrame: ...

    def now(self, transitions: DataFrame, upto=None) -> DataFrame:
        return totals(self.contribution(path_deltas(transitions)), self.keys, upto)

    def at(self, transitions: DataFrame, labels: Sequence) -> DataFrame:
        return totals_at(self.contribution(path_deltas(transitions)), self.keys, labels)


def replay_with(transitions: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: Sequence[str] = ("rc", "peer_ip", "pfx")) -> DataFrame:
    """Any Python observer: step gets each group's transitions in replay order.

    By default a group is a key of the table, which keeps groups small. A coarser by (such as rc) holds a whole group in one
    task's memory, and a group never sees the others' events.
    """
    order = ["file_label", "line_no"]
    return transitions.groupBy(*by).applyInPandas(lambda g: step(g.sort_values(order, kind="stable")), schema)
