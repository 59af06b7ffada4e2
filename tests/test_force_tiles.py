"""Forces by tiles against all pairs at once."""

import numpy as np
import pytest

from seqloom.operators import spatial


@pytest.mark.parametrize("unit", [None, 2.0**-46, 2.0**-20])
def test_tiles_add_up_to_all_pairs(monkeypatch, unit):
    """A block's pairs were arrays of all its pairs: larger blocks, which are copied less often, did not fit."""
    rng = np.random.default_rng(2)
    at, mass = rng.integers(-9, 9, (3, 150)).astype(float), rng.random(150) * 3
    at[:, 7], at[0, 9] = at[:, 8], np.nan  # one place; no number
    d = at[:, None, :] - at[:, :, None]
    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        pairs = np.where(r2 > 0, mass * d / (np.sqrt(r2) * r2), 0.0)
    true = (pairs if unit is None else np.floor(pairs / unit + 0.5).astype(np.int64)).sum(axis=2)
    for tile in ((7, 11), (64, 1_024)):
        monkeypatch.setattr(spatial, "TILE", tile)
        got = spatial._forces(at, at, mass, unit)
        assert np.allclose(got, true, atol=1e-12) if unit is None else (got == true).all() and got.dtype == np.int64
