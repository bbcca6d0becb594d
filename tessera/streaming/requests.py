"""The circuit breaker as a stream: state a domain, carried over batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hits import BREAKER


def tripped_stream(requests: DataFrame, limit: int = BREAKER) -> DataFrame:
    """(domain, tripped_at) once for every domain of a stream (domain, t, event_id, ok) that fails ``limit`` times in a row.

    A success ends a run of failures, but a domain that has tripped stays so.  State is two numbers a domain.
    Requests of one batch are taken in the order of t and event_id, batches in the order they come; a domain's
    requests of one batch are held at once, so a source's ``maxFilesPerTrigger`` bounds them.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, tripped = state.get if state.exists else (0, False)
        if tripped:
            return
        batch = pd.concat([f[["t", "event_id", "ok"]] for f in frames]).sort_values(["t", "event_id"])
        for t, ok in zip(batch["t"], batch["ok"]):
            failures = 0 if ok else failures + 1
            if failures >= limit:
                state.update((failures, True))
                yield pd.DataFrame({"domain": [key[0]], "tripped_at": [t]})
                return
        state.update((failures, False))

    kind = requests.schema["domain"].dataType.simpleString()
    return requests.groupBy("domain").applyInPandasWithState(step, f"domain {kind}, tripped_at timestamp", "failures int, tripped boolean", "append", GroupStateTimeout.NoTimeout)
