"""Sentences from a stream of text fragments: what has no end yet waits in state for the next fragment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A sentence ends with a mark before a blank, or with a line.
END = re.compile(r"(?<=[.!?。！？])\s+|\n+")


def cut_sentences(waiting: str, text: str) -> tuple[list[str], str]:
    """(whole sentences, what still waits)."""
    *whole, rest = END.split(waiting + text)
    return [s for s in (w.strip() for w in whole) if s], rest


def sentences(stream: DataFrame, key: str, order: str, text: str, time: str, late: str = "10 minutes") -> DataFrame:
    """(key, sentence_no, sentence) of fragments (key, order, text, event time) that arrive in order of batches.

    Within a batch, a key's fragments are taken by `order`. Once the watermark passes a key's last fragment
    by `late`, what waits is its last sentence, its state goes, and its numbers would start again. Null text is empty.
    """
    millis = int(pd.Timedelta(late).total_seconds() * 1000)

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, waiting = state.get if state.exists else (0, "")
        if state.hasTimedOut:
            state.remove()
            found = [waiting.strip()] if waiting.strip() else []
        else:
            own = pd.concat(list(batches)).sort_values(order, kind="stable")
            found = []
            for piece in own[text].fillna(""):
                whole, waiting = cut_sentences(waiting, piece)
                found += whole
            state.update((number + len(found), waiting))
            last = int(own[time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({key: [name[0]] * len(found), "sentence_no": range(number, number + len(found)), "sentence": found})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, order, text, time).withWatermark(time, late).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, sentence_no long, sentence string", "number long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
