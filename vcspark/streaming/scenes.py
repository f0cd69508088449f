"""A video's frames as they come: requests of bounded size, late frames, scenes, sampling, tracks, and the flush of a scene that had too few frames.

One step serves a batch (all jobs of a task in one sorted pass) and a stream (state by job, with a timer). A
job ends with a frame marked ``last``, or when none has come for a while; then its open
scene is closed, as it is when the next scene begins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vcspark.operators.tracking import Tracker
from vcspark.streaming.sampling import Sampling, step

#: Frames of a request, difference from the frame before that opens a scene.
REQUEST_FRAMES = 25
SCENE_DIFFERENCE = 0.1

EVENTS = (
    "job_id string, n long, kind string, frame_id long, at double, scene_id int, keep boolean, reason string, detection_id long, track_id string, "
    "start double, `end` double, frames int, analyzed int, status string"
)
_FIELDS = [f.strip().split()[0].strip("`") for f in EVENTS.split(",")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
_KINDS = [_ARROW[f.split()[1]] for f in EVENTS.split(",")]
STATE = "state string"


def new_state() -> dict[str, Any]:
    return {"n": 0, "request": None, "in_request": 0, "up_to": None, "scene": None, "pending": None, "sampling": {}, "tracks": [], "issued": 0, "late": 0, "over": 0, "closed": False}


def _analyse(state: dict[str, Any], at: float, detections: list[dict[str, Any]] | None) -> list[dict[str, Any]]:
    """Give the frame's detections their tracks."""
    tracker = Tracker(state["tracks"], state["issued"])
    ordered = sorted(detections or [], key=lambda d: d["detection_id"])
    ids = tracker.step(at, [SimpleNamespace(**d) for d in ordered])
    state["tracks"], state["issued"] = tracker.tracks, tracker.issued
    return [{"kind": "track", "detection_id": d["detection_id"], "track_id": t} for d, t in zip(ordered, ids)]


def _close(state: dict[str, Any], rules: Sampling, required: bool) -> list[dict[str, Any]]:
    """Close the open scene; if it is below its quota, its last discarded frame is analysed after all."""
    scene, pending, out = state["scene"], state["pending"], []
    if scene is None:
        return out
    if pending is not None and scene["analyzed"] < rules.least and scene["start"] <= pending["at"] <= scene["end"]:
        same = {"frame_id": pending["frame_id"], "at": pending["at"], "scene_id": scene["scene_id"]}
        out.append({"kind": "frame", "keep": True, "reason": "kept:scene_last", **same})
        out += [same | t for t in _analyse(state, pending["at"], pending["detections"])]
        scene["analyzed"] += 1
        state["sampling"].update(kept_hash=pending["hash"], kept_at=pending["at"])
    status = "failed" if required and not scene["analyzed"] else "completed"
    out.append({"kind": "scene", "status": status, **{k: scene[k] for k in ("scene_id", "start", "end", "frames", "analyzed")}})
    state["pending"] = None
    return out


def advance(state: dict[str, Any], frame: dict[str, Any], rules: Sampling, required: bool = True) -> list[dict[str, Any]]:
    """Take one frame: what comes of it, in order; ``state`` moves on."""
    at, same = frame["at"], {"frame_id": frame["frame_id"], "at": frame["at"]}
    state["in_request"] = state["in_request"] + 1 if frame["request"] == state["request"] else 1
    state["request"] = frame["request"]
    discard = lambda reason, **more: {"kind": "frame", "keep": False, "reason": reason, **same, **more}
    if state["closed"]:
        return [discard("discarded:closed")]
    if state["in_request"] > REQUEST_FRAMES:
        state["over"] += 1
        return [discard("discarded:over_request")]
    if state["up_to"] is not None and at <= state["up_to"]:
        state["late"] += 1
        return [discard("discarded:late")]
    changed = frame["difference"] is not None and frame["difference"] >= SCENE_DIFFERENCE
    out = []
    if state["scene"] is None or changed:
        out += _close(state, rules, required)
        number = state["scene"]["scene_id"] + 1 if state["scene"] else 1
        state["scene"] = {"scene_id": number, "start": at, "end": at, "frames": 0, "analyzed": 0}
    scene = state["scene"]
    sampling = dict(state["sampling"])
    if sampling:
        sampling["in_scene"] = scene["analyzed"]
    keep, reason = step(sampling, at, frame["hash"], not scene["frames"], rules, bool(frame["local_change"]))
    state["sampling"] = sampling
    state["up_to"], scene["end"] = at, at
    scene["frames"] += 1
    out.append({"kind": "frame", "keep": keep, "reason": reason, "scene_id": scene["scene_id"], **same})
    if keep:
        state["pending"] = None
        out += [same | {"scene_id": scene["scene_id"]} | t for t in _analyse(state, at, frame["detections"])]
        scene["analyzed"] += 1
    else:
        state["pending"] = {k: frame[k] for k in ("frame_id", "at", "hash", "detections")}
    if frame["last"]:
        out += finish(state, rules, required)
    return out


def finish(state: dict[str, Any], rules: Sampling, required: bool = True) -> list[dict[str, Any]]:
    """The end of a job: its last scene is closed, and what comes later is discarded."""
    out = _close(state, rules, required)
    state["scene"], state["closed"] = None, True
    return out


_COLUMNS = ["job_id", "request", "frame_id", "at", "hash", "difference", "local_change", "last", "detections"]


def _needed(frames: DataFrame, *more: str) -> DataFrame:
    """The columns that count; whole numbers as text, which pandas leaves exact beside nulls."""
    exact = {c: F.col(c).cast("string") for c in ("job_id", "request", "frame_id")}
    return frames.select(*[exact.get(c, F.col(c)).alias(c) for c in _COLUMNS], *more)


def _frames(rows: pd.DataFrame) -> list[dict[str, Any]]:
    """Usable frames in order: by request, then time and id; those without a finite time are left out. A null request is 0."""
    plain = lambda v: None if v is None or v != v else v
    whole = lambda v: None if plain(v) is None else int(v)
    out = []
    for r in rows.to_dict("records"):
        if plain(r["at"]) is None or abs(r["at"]) == float("inf"):
            continue
        found = [{k: plain(v) for k, v in dict(d.asDict() if hasattr(d, "asDict") else d).items()} for d in (r["detections"] if r["detections"] is not None else [])]
        out.append({
            "request": whole(r["request"]) or 0, "frame_id": whole(r["frame_id"]), "at": float(r["at"]), "hash": plain(r["hash"]), "difference": plain(r["difference"]),
            "local_change": bool(plain(r["local_change"])), "last": bool(plain(r["last"])), "detections": [d for d in found if whole(d["detection_id"]) is not None],
        })
    return sorted(out, key=lambda f: (f["request"], f["at"], f["frame_id"] is None, f["frame_id"] or 0))


def _events(job: str, state: dict[str, Any], made: list[dict[str, Any]]) -> pd.DataFrame:
    rows = []
    for event in made:
        state["n"] += 1
        rows.append([job, state["n"], *[event.get(f) for f in _FIELDS[2:]]])
    table = pd.DataFrame(rows, columns=_FIELDS)
    for name in ("frame_id", "detection_id", "scene_id", "frames", "analyzed"):
        table[name] = pd.array(table[name].tolist(), dtype="Int64")
    return table


def _usable(request: int, frame_id: int | None, at: float, picture: str | None, difference: float | None, local_change: bool | None, last: bool | None, detections: list[dict[str, Any]] | None) -> dict[str, Any]:
    """A frame as ``advance`` takes it, from columns that hold it exactly; NaN is null."""
    found = [{k: None if v != v else v for k, v in d.items()} for d in detections or [] if d is not None]
    return {
        "request": request, "frame_id": frame_id, "at": at, "hash": picture, "difference": None if difference != difference else difference,
        "local_change": bool(local_change), "last": bool(last), "detections": [d for d in found if d["detection_id"] is not None],
    }


def _batch(events: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e.get(f) for e in events], kind) for f, kind in zip(_FIELDS, _KINDS)], names=_FIELDS)


def scene_events(frames: DataFrame, rules: Sampling | None = None, required: bool = True, flush: bool = True) -> DataFrame:
    """Events of a batch of frames: one ``frame`` for each with a decision, ``track`` for each detection analysed, ``scene`` for each scene closed.

    ``frames``: job_id, request (number of the upload, at most ``REQUEST_FRAMES`` of its
    frames by time are taken), frame_id, at (seconds), hash, difference (from the frame
    before; null: no scene change), local_change, last, detections (array of structs with
    detection_id, name, category, x, y, width, height). ``n`` orders a job's events.
    Frames not after the last one taken are late. With ``flush`` the end of the table is
    the end of every job. Jobs are shuffled together and sorted, and a task takes its
    frames one after the other, with the state of one job in memory.
    """
    rules = rules or Sampling()
    whole = {"job_id": "string", "request": "long", "frame_id": "long", "at": "double"}
    rows = frames.select(*[F.col(c).cast(whole[c]).alias(c) if c in whole else c for c in _COLUMNS])
    rows = rows.withColumn("request", F.coalesce("request", F.lit(0))).where("at is not null and not isnan(at) and abs(at) <> double('inf')")
    ordered = rows.repartition("job_id").sortWithinPartitions("job_id", "request", "at", F.col("frame_id").asc_nulls_last())

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state, made = None, None, []

        def told(events: list[dict[str, Any]]) -> None:
            for event in events:
                state["n"] += 1
                made.append({"job_id": job, "n": state["n"], **event})

        for part in parts:
            jobs, columns = part.column("job_id").to_pylist(), [part.column(c).to_pylist() for c in _COLUMNS[1:]]
            for of, *values in zip(jobs, *columns):
                if state is None or of != job:
                    if state is not None and flush and not state["closed"]:
                        told(finish(state, rules, required))
                    job, state = of, new_state()
                told(advance(state, _usable(*values), rules, required))
            yield _batch(made)
            made = []
        if state is not None and flush and not state["closed"]:
            told(finish(state, rules, required))
            yield _batch(made)

    return ordered.mapInArrow(fold, EVENTS)


def scene_stream(frames: DataFrame, rules: Sampling | None = None, required: bool = True, idle: str = "10 minutes", late: str = "1 minute", received: str = "received_at") -> DataFrame:
    """The same events over a stream; state is kept by job, and a timer closes a job that sends nothing for ``idle`` of event time.

    ``received`` is when a frame arrived (not null), the time that watermark and timer go by.
    Frames of a job closed by the timer open nothing again: they are discarded as closed
    for another ``idle``, after which the state goes.
    """
    rules = rules or Sampling()
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple[str], parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else new_state()
        if held.hasTimedOut:
            if state["closed"]:
                held.remove()
                return
            made = finish(state, rules, required)
            state["heard"] = held.getCurrentWatermarkMs()
        else:
            rows = pd.concat(list(parts))
            state["heard"] = max(state.get("heard", 0), int(rows[received].max().timestamp() * 1000))
            made = []
            for frame in _frames(rows):
                made += advance(state, frame, rules, required)
        table = _events(key[0], state, made)
        held.update((json.dumps(state),))
        held.setTimeoutTimestamp(max(state["heard"], held.getCurrentWatermarkMs()) + wait)
        yield table

    return _needed(frames, received).withWatermark(received, late).groupBy("job_id").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
