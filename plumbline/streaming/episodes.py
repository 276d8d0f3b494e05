"""Episodes over a stream of block and pass lines: state per key is one open episode.

The log's own order is the order (there is no event time and no watermark): within a micro-batch lines are taken
by `ord`. A key's state is a count and three numbers; it goes when a pass resolves the episode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, metric long, blocks long, blocked_at long, head double, resolved_at long, passed double"
STATE = "blocks long, blocked_at long, head double"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lines = pd.concat(list(batches)).sort_values("ord", kind="stable")  # one key's lines of one micro-batch
    blocks, since, head = state.get if state.exists else (0, None, None)
    done = []
    for at, event, value in zip(lines["ord"], lines["event"], lines["value"]):
        if event == "block":
            blocks, since, head = blocks + 1, int(at) if since is None else since, float(value)
        elif blocks:
            done.append((*key, blocks, since, head, int(at), float(value)))
            blocks, since, head = 0, None, None
    if blocks:
        state.update((blocks, since, head))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(done, columns=["user_id", "metric", "blocks", "blocked_at", "head", "resolved_at", "passed"])


def resolved(stream: DataFrame) -> DataFrame:
    """Resolved episodes of a stream of (user_id, metric, ord, event, value)."""
    return stream.groupBy("user_id", "metric").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
