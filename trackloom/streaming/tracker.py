"""Streaming predictions of tracks; ``autotrack`` follows points through images."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .autotrack import predicted


def track_stream(samples: DataFrame, window: int = 11) -> DataFrame:
    """Streaming predictions: samples (track, frame, u) in, track, frame and the predicted next value out.

    State per track is its last ``window`` frames and values; late frames are
    put in order within the state, older ones than it holds are dropped.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, values = state.get if state.exists else ([], [])
        held = dict(zip(frames, values))
        for g in batches:
            held.update((int(r.frame), float(r.u)) for r in g.itertuples() if r.u == r.u)
        keep = sorted(held)[-window:]
        state.update((keep, [held[f] for f in keep]))
        if keep:
            yield pd.DataFrame({"track": [key[0]], "frame": [keep[-1] + 1], "predicted": [float(predicted([held[f] for f in keep]))]})

    return samples.groupBy("track").applyInPandasWithState(step, "track string, frame int, predicted double", "frames array<int>, values array<double>", "append", GroupStateTimeout.NoTimeout)
