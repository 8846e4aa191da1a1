"""Motion of scenes that rest."""

import random

import numpy as np
import pytest

from orbitframe.functions import raster
from orbitframe.operators import frames as fr


def picture(px):
    return {"height": px.shape[0], "width": px.shape[1], "channels": px.shape[2], "data": px.tobytes()}


def test_equal_pictures_need_no_flow(monkeypatch):
    px = np.random.default_rng(5).integers(0, 255, (144, 256, 1), np.uint8)
    assert np.abs(raster.dense_flow(px[..., 0], px[..., 0])).max() == 0.0  # so that the short way is the same

    def never(*_):
        raise AssertionError("flow of equal pictures")

    monkeypatch.setattr(raster, "dense_flow", never)
    assert fr.picture_motion(picture(px), picture(px.copy())) == 0.0 and fr.picture_motion(None, picture(px)) == 0.0
    with pytest.raises(AssertionError):
        fr.picture_motion(picture(px), picture(px[::-1]))


def test_motion_keys_of_resting_scenes(spark):
    rng = np.random.default_rng(6)
    shots = [rng.integers(0, 255, s, np.uint8) for s in ((8, 8, 1), (8, 8, 1), (60, 90, 3), (200, 300, 1))] + [None]
    rows, want = [], set()
    for job in (1, 2):
        last, order = None, random.Random(job)
        for k in range(12):
            px = shots[order.randrange(5) if k else 0]
            rows += [(f"{job}", k * 3 + r, None if px is None else picture(px)) for r in range(3)]
            moved = last is not None and px is not None and raster.motion_score(raster.motion_input(last), raster.motion_input(px)) > 0.5
            if last is None or moved:
                want.add((f"{job}", k * 3))
                last = px
    df = spark.createDataFrame(rows, f"path string, frame_idx int, image {raster.IMAGE}").repartition(5)
    assert {tuple(r) for r in fr.motion_keys(df, 0.5).collect()} == want and len(want) > 4
