"""Queries without SQL read whole tables: each against a plain version on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from framewright.operators import kernels
from framewright.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def read(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def test_tiled_fusion_fuses_every_vector(spark):
    e = read("embeddings").sort_values("vec_id")
    got = {(r["image"], r["y"]): r["pixels"] for r in QUERIES["tiled_fusion"](spark, DATA).collect()}
    want = e.groupby(e.vec_id // 4)["embedding"]
    assert len(got) == 8 * want.ngroups
    for image, vectors in want:
        stack = np.clip(0.5 + np.stack(vectors.to_list()).astype(float), 0, 1).reshape(-1, 8, 8)
        assert np.allclose(np.stack([got[image, y] for y in range(8)]), kernels.fuse_tiled(stack, 6, 2))


def test_vanishing_points_take_every_segment(spark):
    l = read("lineitem").astype({"l_quantity": float, "l_discount": float})
    got = {r["l_suppkey"]: (r["lines"], r["inliers"]) for r in QUERIES["vanishing_points"](spark, DATA).collect()}
    assert sum(n for n, _ in got.values()) == len(l)
    for key, g in l.groupby("l_suppkey"):
        rows = sorted(zip(g.l_quantity, g.l_discount * 100, g.l_quantity * 0.9 + 2, g.l_discount * 100 + 20))
        assert got[key] == (len(g), kernels.vanishing_point(np.array(rows))[1].sum())


def test_farthest_point_uses_every_component(spark):
    e = read("embeddings")
    x = np.stack(e["embedding"].to_list()).astype(float)
    centre = pd.DataFrame(x).groupby(e["label"].to_numpy()).mean()
    z = ((centre - centre.mean()) / (centre.std(ddof=0) + 1e-9)).to_numpy()
    chosen = [int(np.linalg.norm(z, axis=1).argmin())]
    while len(chosen) < 4:
        gap = np.linalg.norm(z[:, None] - z[None, chosen], axis=2).min(1)
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
    got = {r["pick"]: r["label"] for r in QUERIES["farthest_point"](spark, DATA).collect()}
    assert x.shape[1] == 64 and got == {i + 1: centre.index[c] for i, c in enumerate(chosen)}
