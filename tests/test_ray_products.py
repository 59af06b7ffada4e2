"""First hits by products of matrices against every pair by itself."""

import numpy as np
import pandas as pd
import pytest

from seqloom.operators import spatial


@pytest.mark.parametrize("scale, grid", [(1.0, 0), (1e-3, 0), (1e4, 8), (1.0, 3)])
def test_first_hits_are_those_of_all_pairs(monkeypatch, scale, grid):
    """On a grid rays meet edges, corners and planes exactly, where rounding decides; the result must not change with it."""
    rng = np.random.default_rng(grid)
    x = rng.normal(size=(150, 15))
    x = (np.round(x * grid) / grid if grid else x) * scale
    o, d, a, b, c = (x[:, i : i + 3] for i in range(0, 15, 3))
    true = {}
    for i in range(120):
        with np.errstate(divide="ignore", invalid="ignore"):
            e1, e2, s = b - a, c - a, o[i] - a
            p, q = np.cross(d[i], e2), np.cross(s, e1)
            det = (e1 * p).sum(axis=1)
            u, w, t = (s * p).sum(axis=1) / det, (d[i] * q).sum(axis=1) / det, (e2 * q).sum(axis=1) / det
            hit = np.flatnonzero((np.abs(det) > 1e-12) & (u >= 0) & (w >= 0) & (u + w <= 1) & (t > 1e-12))
        if len(hit):
            true[i] = min((t[k], k) for k in hit)
    assert len(true) > (40 if scale > 1e-2 else -1)
    rays, tris = pd.DataFrame({"ray": range(120), "o": list(o[:120]), "d": list(d[:120])}), pd.DataFrame({"tri": range(150), "a": list(a), "b": list(b), "c": list(c)})
    for tile in ((64, 1_024), (7, 11)):
        monkeypatch.setattr(spatial, "PAIRS", tile)
        got = spatial._first_hits(rays, tris)
        assert {r.ray: (r.t, r.tri) for r in got.itertuples()} == true
