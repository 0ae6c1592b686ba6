"""The replay as a stream: the last path of each key is kept as state, and each micro-batch gives its transitions.

Batches must follow the order of file labels; within a batch each key's events are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "rc string, peer_ip string, pfx string, fam int, file_label {label}, line_no bigint, path array<bigint>, prev array<bigint>, kind string"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["file_label", "line_no"], kind="stable")
    last = list(state.get[0]) if state.exists and state.get[0] is not None else None
    path = [None if p is None else list(p) for p in rows["path"]]
    prev = [last, *path[:-1]]
    to, of = (np.array([p is not None for p in column]) for column in (path, prev))
    kind = np.select([rows["src"] == "B", to, of], ["B", "A", "W"], "")
    state.update((None if path[-1] is None else [int(x) for x in path[-1]],))  # numbers of numpy are no state
    out = rows[["fam", "file_label", "line_no"]].assign(path=path, prev=prev, kind=kind)
    for place, (name, value) in enumerate(zip(("rc", "peer_ip", "pfx"), key, strict=True)):
        out.insert(place, name, value)
    yield out[kind != ""]


def transitions_stream(log: DataFrame) -> DataFrame:
    """Transitions of a streaming log of events (as operators.replay.events gives them)."""
    out = OUT.format(label=dict(log.dtypes)["file_label"])
    return log.groupBy("rc", "peer_ip", "pfx").applyInPandasWithState(_step, out, "path array<bigint>", "append", GroupStateTimeout.NoTimeout)
