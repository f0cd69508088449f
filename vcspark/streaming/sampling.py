"""Which frames of a video are analysed: a decision that depends on the one before, as keyed state.

The same step serves a batch (grouped pandas) and a stream (state by job).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "job_id string, frame_id long, at double, keep boolean, reason string"
STATE = "at double, hash string, kept_hash string, kept_at double, in_scene int, late long"


@dataclass
class Sampling:
    """Fixed values as defaults: frames by scene, bits that still count as the same picture, seconds between frames."""

    least: int = 2
    most: int = 8
    distance: int = 6
    interval: float = 1.0
    hashed: bool = True


def _bits(a: str | None, b: str | None) -> int:
    if not a or not b or len(a) != len(b):
        return 64
    return (int(a, 16) ^ int(b, 16)).bit_count()


def step(state: dict[str, Any], at: float, picture: str | None, scene_changed: bool, rules: Sampling, local_change: bool = False) -> tuple[bool, str]:
    """Decide one frame by the first rule that applies, and move the state on."""
    count = 0 if scene_changed or not state else state["in_scene"]
    near = bool(state) and state["kept_hash"] is not None and picture is not None and _bits(picture, state["kept_hash"]) <= rules.distance
    since = None if not state or state["kept_at"] is None else at - state["kept_at"]
    if not rules.hashed:
        keep, reason = True, "kept:hash_disabled"
    elif scene_changed or not state:
        keep, reason = True, "kept:scene_first"
    elif count >= rules.most:
        keep, reason = False, "discarded:max_frames_cap"
    elif not near:
        keep, reason = True, "kept:visual_change"
    elif local_change:
        keep, reason = True, "kept:local_change"
    elif count < rules.least:
        keep, reason = True, "kept:min_frames_quota"
    elif since is not None and since >= rules.interval:
        keep, reason = True, "kept:max_gap"
    else:
        keep, reason = False, "discarded:near_duplicate"
    before = dict(state)
    state.update(at=at, hash=picture, kept_hash=picture if keep else before.get("kept_hash"), kept_at=at if keep else before.get("kept_at"), in_scene=count + keep, late=before.get("late", 0))
    return keep, reason


def _decide(job: str, rows: pd.DataFrame, state: dict[str, Any], rules: Sampling) -> pd.DataFrame:
    out = []
    for row in rows.sort_values(["at", "frame_id"], kind="stable").itertuples():
        if state and row.at <= state["at"]:
            state["late"] += 1
            out.append((job, row.frame_id, row.at, False, "discarded:late"))
        else:
            out.append((job, row.frame_id, row.at, *step(state, row.at, row.hash, bool(row.scene_changed), rules, bool(getattr(row, "local_change", False)))))
    return pd.DataFrame(out, columns=["job_id", "frame_id", "at", "keep", "reason"])


def sample_frames(frames: DataFrame, rules: Sampling | None = None) -> DataFrame:
    """Decisions for a batch of frames (job_id, frame_id, at, hash, scene_changed), each job's in order of time, then id.

    A column local_change, if there is one, says that the picture inside an active box
    changed since the last frame (``functions.hashing.hamming`` of the box's hashes). A
    frame not after the last one of its job is late: dropped and reported. A job is a
    video, some thousands of frames.
    """
    rules = rules or Sampling()
    return frames.groupBy("job_id").applyInPandas(lambda key, rows: _decide(key[0], rows, {}, rules), OUTPUT)


def sample_stream(frames: DataFrame, rules: Sampling | None = None) -> DataFrame:
    """The same decisions over a stream, with the state of each job kept between batches."""
    rules = rules or Sampling()
    names = [f.strip().split()[0] for f in STATE.split(",")]

    def run(key: tuple[str], parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(names, held.get)) if held.exists else {}
        rows = pd.concat(list(parts))
        yield _decide(key[0], rows, state, rules)
        if state:
            held.update(tuple(state[n] for n in names))

    return frames.groupBy("job_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
