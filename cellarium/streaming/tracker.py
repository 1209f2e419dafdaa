"""Tracking labelled regions over the frames of a session.

A region continues the track it overlaps most, or else the nearest one; boxes are smoothed, tracks
that are not seen for a while end, and texts that are not read for a while fade. Tracks are keyed
state of their session, so sessions scale out and each session's frames are taken in time order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Least overlap, greatest distance of centres, smoothing, seconds a track and a text live on.
LEAST_OVERLAP, NEAR, SMOOTH, GRACE_S, TEXT_S, READY_FRAMES = 0.25, 0.06, 0.5, 1.5, 3.0, 2

Box = tuple[float, float, float, float]


def overlap(a: Box, b: Box) -> float:
    """Intersection over union of boxes ``x, y, width, height``."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def centre_distance(a: Box, b: Box) -> float:
    return (((a[0] + a[2] / 2) - (b[0] + b[2] / 2)) ** 2 + ((a[1] + a[3] / 2) - (b[1] + b[3] / 2)) ** 2) ** 0.5


def advance(tracks: dict[str, dict], t: float, regions: list[tuple[Box, list[str]]]) -> dict[str, dict]:
    """Tracks after a frame: best affinities first, each region and each track at most once."""
    live = {k: v for k, v in tracks.items() if k == "next" or t - v["seen"] <= GRACE_S}
    number = live.pop("next", {"n": 0})["n"]
    offers = []
    for i, (box, _) in enumerate(regions):
        for k, v in live.items():
            o, d = overlap(box, tuple(v["box"])), centre_distance(box, tuple(v["box"]))
            if o >= LEAST_OVERLAP or d <= NEAR:
                offers.append((-(o if o >= LEAST_OVERLAP else NEAR - d - 1), i, k))
    taken: dict[int, str] = {}
    for _, i, k in sorted(offers):
        if i not in taken and k not in taken.values():
            taken[i] = k
    for i, (box, texts) in enumerate(regions):
        k = taken.get(i)
        if k is None:
            k, number = f"t{number}", number + 1
            live[k] = {"box": list(box), "seen": t, "frames": 0, "texts": {}}
        v = live[k]
        v["box"] = [SMOOTH * a + (1 - SMOOTH) * b for a, b in zip(v["box"], box)]
        v["seen"], v["frames"] = t, v["frames"] + 1
        v["texts"] = {x: at for x, at in v["texts"].items() if t - at <= TEXT_S} | {x: t for x in texts}
    return live | {"next": {"n": number}}


def track(frames: DataFrame) -> DataFrame:
    """``session_id, t, track_id, frames, ready, texts`` for a stream of ``session_id, t, x, y, w, h, text``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracks = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for t, frame in rows.groupby("t"):
            tracks = advance(tracks, float(t), [((r.x, r.y, r.w, r.h), [r.text] if isinstance(r.text, str) and r.text else []) for r in frame.itertuples()])
            out += [(key[0], float(t), k, v["frames"], v["frames"] >= READY_FRAMES, " ".join(sorted(v["texts"]))) for k, v in tracks.items() if k != "next" and v["seen"] == float(t)]
        state.update((json.dumps(tracks),))
        yield pd.DataFrame(out, columns=["session_id", "t", "track_id", "frames", "ready", "texts"])

    return frames.groupBy("session_id").applyInPandasWithState(step, "session_id long, t double, track_id string, frames long, ready boolean, texts string", "tracks string", "append", "NoTimeout")
