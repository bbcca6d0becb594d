"""Operations that need a model, a decoder or a network: the interface, run batch by batch on executors.

A backend is made once per task from a factory that can be pickled; without one, the call raises at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

BATCH = 32


class BackendMissing(RuntimeError):
    """The operation needs a backend that this installation does not have."""


#: Output columns of each operation beside ``path``.
OUTPUTS = {
    "embed": "embedding array<float>",
    "detect": "class string, score double, x0 double, y0 double, x1 double, y1 double",
    "quality": "metric string, value double",
    "faces": "face int, image binary",
    "upscale": "image binary",
    "frames": "t double, image binary",
    "download": "status string, content binary, content_type string",
}


def apply_model(items: DataFrame, operation: str, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]] | None, batch: int = BATCH) -> DataFrame:
    """``path`` and the operation's outputs; the backend takes at most ``batch`` rows (path, content) at once."""
    if operation not in OUTPUTS:
        raise ValueError(f"no such operation: {operation}")
    if factory is None:
        raise BackendMissing(f"{operation} needs a backend")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield backend(frame.iloc[at : at + batch])

    return items.select("path", "content").mapInPandas(run, f"path string, {OUTPUTS[operation]}")
