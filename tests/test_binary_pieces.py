"""A binary graph is written and read in pieces."""

import struct

import numpy as np

from seqloom.sources import files


def test_pieces_make_the_array_and_are_read_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 5)
    rng = np.random.default_rng(3)
    n, rows = 23, sorted({(3, int(x)) for x in range(14)} | {(int(a), int(b)) for a, b in rng.integers(0, 20, (40, 2))})
    own = [(a, b, float(i) / 4) for i, (a, b) in enumerate(rows)]
    whole = struct.pack("<I", n) + np.cumsum(np.bincount([a for a, _ in rows], minlength=n)).astype("<u8").tobytes() + np.array([b for _, b in rows]).astype("<u4").tobytes()
    edges = spark.createDataFrame(own[::-1], "src long, dst long, w float")
    for weighted in (True, False):
        path = str(tmp_path / f"csr-{weighted}")
        files.write_csr(spark.range(n), edges if weighted else edges.drop("w"), path)
        pieces = sorted((r["part"], r["at"], bytes(r["data"])) for r in spark.read.parquet(path).collect())
        assert len(pieces) > 15 and b"".join(d for p, _, d in pieces if p == 0) == whole
        assert b"".join(d for p, _, d in pieces if p == 1) == (np.array([w for *_, w in own]).astype("<f4").tobytes() if weighted else b"")
        got = sorted(tuple(r) for r in files.read_csr(spark, path).collect())
        assert got == (own if weighted else [(a, b, None) for a, b in rows])
    none = str(tmp_path / "none")
    files.write_csr(spark.range(2), edges.limit(0), none)
    assert files.read_csr(spark, none).count() == 0
