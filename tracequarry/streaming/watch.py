"""Verdict transitions over time.

Polls (path, size, mtime, verdict, at) stream in; a file counts once its size
and time are the same in two polls running (debounce); a transition is emitted
when its verdict differs from the last one told. The first healthy verdict is
silent, and files that vanish keep theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "path string, at timestamp, before string, verdict string"
STATE = "size long, mtime long, verdict string"


def step(state: tuple | None, polls: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """(new state, transitions) after further polls of one file, in time order."""
    out = []
    for p in polls.sort_values("at").itertuples():
        mark = (int(p.size_bytes), int(p.mtime))
        told = state[2] if state else None
        if state and (state[0], state[1]) == mark and p.verdict != told:
            if not (told is None and p.verdict == "healthy"):
                out.append((p.at, told, p.verdict))
            told = p.verdict
        state = (*mark, told)
    return state, out


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    polls = pd.concat(list(frames))
    new, told = step(held, polls)
    if new is not None:
        state.update(new)
    if told:
        yield pd.DataFrame({"path": [key[0]] * len(told), "at": [t[0] for t in told], "before": [t[1] for t in told], "verdict": [t[2] for t in told]})


def transitions(polls: DataFrame) -> DataFrame:
    """A streaming DataFrame of transitions from one of polls (path, size_bytes, mtime, verdict, at)."""
    return polls.groupBy("path").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
