"""Keyframe selection: one step function for batch and stream.

A frame is taken when it differs much from the frame before, or when enough time has
passed since the last one taken; then it is dropped again if it nearly equals the last
one taken.  A taken change starts a new shot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bits that make a scene change, bits below which a frame is a copy.
SCENE_DISTANCE, DUPLICATE_DISTANCE, NO_PREVIOUS = 18, 6, 64
STATE = "previous long, taken_hash long, taken_ms long, shot long, taken long"
OUTPUT = "ts_ms long, shot long, reason string, digest long"


@dataclass
class State:
    previous: int | None = None
    taken_hash: int | None = None
    taken_ms: int = -(10**9)
    shot: int = 0
    taken: int = 0


def _distance(a: int | None, b: int) -> int:
    return NO_PREVIOUS if a is None else ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()


def step(s: State, ts_ms: int, digest: int, interval_ms: int, most: int | None = None) -> tuple[int, int, str, int] | None:
    """Moves the state over one frame; the keyframe if it is one."""
    changed = _distance(s.previous, digest) >= SCENE_DISTANCE
    due = interval_ms > 0 and ts_ms - s.taken_ms >= interval_ms
    s.previous = digest
    if not (changed or due) or _distance(s.taken_hash, digest) < DUPLICATE_DISTANCE or most is not None and s.taken >= most:
        return None
    s.shot += changed
    s.taken += 1
    s.taken_hash, s.taken_ms = digest, ts_ms
    return ts_ms, s.shot, "scene" if changed else "interval", digest


def interval_of(fps: float) -> int:
    """Milliseconds between frames at a floor rate; zero switches it off."""
    return int(1000 / fps) if fps > 0 else 0


def select(frames: DataFrame, recording: str = "recording", ts: str = "ts_ms", digest: str = "digest", interval_ms: int = 2000, most: int | None = None) -> DataFrame:
    """(recording, ts_ms, shot, reason, digest) of the keyframes of every recording.

    Frames are sorted within recordings by Spark and walked as a stream of batches, so a
    long recording isn't held in memory.
    """
    kind = dict(frames.dtypes)[recording]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s = object(), State()
        for pdf in it:
            out = []
            for r, t, d in zip(pdf["r"], pdf["t"], pdf["d"], strict=True):
                if r != now:
                    now, s = r, State()
                if (k := step(s, int(t), int(d), interval_ms, most)) is not None:
                    out.append((r, *k))
            yield pd.DataFrame(out, columns=["r", "ts_ms", "shot", "reason", "digest"])

    rows = frames.where(F.col(recording).isNotNull() & F.col(ts).isNotNull() & F.col(digest).isNotNull())
    rows = rows.select(F.col(recording).alias("r"), F.col(ts).cast("long").alias("t"), F.col(digest).cast("long").alias("d"))
    rows = rows.repartition("r").sortWithinPartitions("r", "t", "d")
    return rows.mapInPandas(run, f"r {kind}, {OUTPUT}").withColumnRenamed("r", recording)


def select_stream(frames: DataFrame, recording: str = "recording", ts: str = "ts_ms", digest: str = "digest", interval_ms: int = 2000, most: int | None = None) -> DataFrame:
    """The same over a stream whose frames arrive in order within a recording; the state
    of a recording survives between micro-batches."""
    kind = dict(frames.dtypes)[recording]

    def run(key: tuple, it: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = State(*state.get) if state.exists else State()
        all_ = pd.concat(list(it)).sort_values([ts, digest], kind="stable")
        out = [(key[0], *k) for t, d in zip(all_[ts], all_[digest], strict=True) if (k := step(s, int(t), int(d), interval_ms, most)) is not None]
        state.update((s.previous, s.taken_hash, s.taken_ms, s.shot, s.taken))
        yield pd.DataFrame(out, columns=[recording, "ts_ms", "shot", "reason", "digest"])

    return frames.groupBy(recording).applyInPandasWithState(run, f"{recording} {kind}, {OUTPUT}", STATE, "append", GroupStateTimeout.NoTimeout)
