import os

import numpy as np
import pytest

from triadic.catalog import stored
from triadic.sources import arrays, matfile

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_files_go_to_the_folder_a_cluster_shares(spark, monkeypatch):
    """As on a cluster: a file: URI of a folder that nothing has made yet."""
    monkeypatch.setattr(stored, "_folder", stored._shared_folder)
    want = stored._daily_array(spark, SF)
    rows = stored.matfield_source(spark, SF).collect()
    assert len(rows) == want.size and all(r.value == pytest.approx(want[r.t, r.i], abs=1e-8) for r in rows)
    rows = stored.arrays_from_files(spark, SF).collect()
    assert len(rows) == 4 * want.size and all(r.value == pytest.approx(want[r.t % len(want), r.p], abs=1e-8) for r in rows)


def test_arrays_by_uri(spark, tmp_path):
    a = np.random.default_rng(1).standard_normal((7, 3))
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", x=a)
    matfile.write_mat(f"{tmp_path}/c.mat", {"x": a})
    for name in ("a.npy", "b.npz", "c.mat"):
        for uri in (f"file://{tmp_path}/{name}", f"file:{tmp_path}/{name}"):
            got = {(r.t, r.p): r.value for r in arrays.load(spark, uri).collect()}
            assert got == {(t, p): a[t, p] for t, p in np.ndindex(a.shape)}
            assert (arrays.read_array(uri) == a).all()
