"""Stacks whose mean and sigma come from all frames of a master, also of many."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from nightloom import catalogue
from nightloom.operators import stack as K

FRAMES = 90  # of which every fourth would set the limits, if at most 20 to 39 did


@pytest.fixture
def frames(tmp_path):
    """A folder with embeddings of one master: even frames lie apart from each other only where a sample of every fourth can't see it."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.01, (FRAMES, 64))
    v[np.arange(FRAMES) % 4 != 0] += rng.normal(0, 0.2, (FRAMES - (FRAMES + 3) // 4, 64))
    v = v.astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(FRAMES), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array([7] * FRAMES, pa.int32())}), tmp_path / "embeddings.parquet")
    return str(tmp_path), v


def matched(v):
    """The samples, matched to the reference frame, and the frames' weights."""
    f = np.arange(FRAMES)[:, None]
    return (v.astype(np.float64) + 0.6 - (0.55 + f % 5 / 100)) * (0.1 / (0.1 + f % 3 / 50)) + 0.55, 1.0 + np.arange(FRAMES) % 4


def test_all_frames_set_the_limits(spark, frames):
    folder, v = frames
    cube, weights = matched(v)
    value, clipped = K.combine(cube, weights, 2.0, 2.5, np.arange(FRAMES))
    got = {r["y"] * 8 + r["x"]: (r["v"], r["clipped"], r["seen"]) for r in catalogue.QUERIES["agg_stack_sigma_clip"](spark, folder).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    twin = {y * 8 + x: (w, c, s) for y, x, w, c, s in duck.execute("SELECT y, x, v, clipped, seen FROM (" + catalogue.ORACLE["agg_stack_sigma_clip"] + ")").fetchall()}
    assert len(got) == 64
    for found in (got, twin):
        assert all(abs(found[k][0] - value[k]) < 2e-6 and found[k][1:] == (clipped[k], FRAMES) for k in range(64))


def test_a_stack_of_all_frames_is_compared(spark, frames):
    folder, v = frames
    cube, weights = matched(v)
    value, clipped = K.combine(cube, weights, 2.0, 2.5, np.arange(FRAMES))
    ratio = cube[0].std(ddof=1) / value.std(ddof=1)
    r = catalogue.QUERIES["agg_stack_compare"](spark, folder).first()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    twin = duck.execute("SELECT frames, clipped_pct, noise_ratio FROM (" + catalogue.ORACLE["agg_stack_compare"] + ")").fetchone()
    for frames_, pct, found in ((r["frames"], r["clipped_pct"], r["noise_ratio"]), twin):
        assert frames_ == FRAMES and abs(pct - 100 * clipped.sum() / cube.size) < 2e-6 and abs(found - ratio) < 2e-4
