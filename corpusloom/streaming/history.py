"""Keyed streams: the last messages of each conversation, kept as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """A stream of (conversation_id, id, role, content) to updates of each conversation's last n, as nth from 1.

    State is n messages a conversation at most. A conversation's rows of one batch are put in order of their ids;
    each update gives all messages that it then holds.
    """

    def trimmed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, roles, contents = (list(x) for x in state.get) if state.exists else ([], [], [])
        for batch in batches:
            ids += batch["id"].tolist()
            roles += batch["role"].tolist()
            contents += batch["content"].tolist()
            order = sorted(range(len(ids)), key=ids.__getitem__)[-n:]
            ids, roles, contents = ([x[i] for i in order] for x in (ids, roles, contents))
        state.update((ids, roles, contents))
        yield pd.DataFrame({"conversation_id": key[0], "nth": range(1, len(ids) + 1), "id": ids, "role": roles, "content": contents})

    return messages.groupBy("conversation_id").applyInPandasWithState(
        trimmed, "conversation_id long, nth long, id long, role string, content string", "ids array<long>, roles array<string>, contents array<string>", "update", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) by window and type; windows close when the watermark passes them. Beyond the reference."""
    timed = events.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
