import pytest

from triadic.operators.triads import enumerate_triads, find_triad, triads
from triadic.plans.config import FitConfig, modes_to_keep, precision

BASE = {"n_dft": 16, "time_step": 0.5, "n_space_dims": 1, "n_variables": 1}


def test_required_and_unknown_keys():
    with pytest.raises(KeyError):
        FitConfig.from_params({"n_dft": 16})
    assert FitConfig.from_params(BASE | {"solver": "x"}).n_overlap == 8


@pytest.mark.parametrize(
    "change,error",
    [
        ({"n_dft": 16.0}, TypeError), ({"n_dft": 3}, ValueError), ({"n_overlap": 16}, ValueError), ({"n_overlap": -1}, ValueError), ({"window": "box"}, ValueError),
        ({"regions": [9]}, ValueError), ({"regions": []}, ValueError), ({"max_freq_idx": 9}, ValueError), ({"dtype": "half"}, ValueError), ({"save_modes_top": True}, TypeError),
        ({"save_modes_top": 0}, ValueError), ({"save_modes_top": 1.5}, ValueError), ({"state_idx": [0]}, ValueError), ({"state_idx": [0], "qr_idx": [[0]]}, ValueError),
        ({"state_idx": [0], "qr_idx": [[0, 1]]}, ValueError), ({"state_idx": [0, 0], "qr_idx": [[0, 0]]}, ValueError), ({"state_idx": [0], "qr_idx": [[0, 0]], "constituent_modes": True}, ValueError),
    ],
)
def test_refusals(change, error):
    with pytest.raises(error):
        FitConfig.from_params(BASE | change)


def test_derived_settings():
    c = FitConfig.from_params(BASE | {"overlap": 33, "regions": 1, "window": "Hann"})
    assert (c.n_overlap, c.step, c.regions, c.window) == (5, 11, (1,), "hann")
    assert c.blocks(27) == 2 and c.folder(38) == "nfft16_novlp5_nblks3"
    with pytest.raises(ValueError):
        c.blocks(26)
    assert precision("single") == precision("float") == "float"
    for ok in (None, 3, 0.5, 1.0):
        modes_to_keep(ok)


def test_size_guard():
    c = FitConfig(n_dft=16, time_step=1.0, store_modes=True, max_modes_gb=0.001)
    with pytest.raises(ValueError, match="max_modes_gb"):
        c.check_size(1000, 1000)
    assert FitConfig(n_dft=16, time_step=1.0, store_modes=True, max_modes_gb=None).check_size(1000, 1000) > 0.02


# Counts that the published results state or imply.
@pytest.mark.parametrize("n,regions,bound,count", [(256, (1, 2), 12, 169), (64, (1, 2), 8, 81), (128, (1,), 40, 780), (480, (1,), 36, 703), (480, (1, 2), None, 43200), (16, (1, 2), 4, 24)])
def test_counts(n, regions, bound, count):
    assert len(enumerate_triads(n, 1.0, regions, bound)["k"]) == count


@pytest.mark.parametrize("case", [(16, 0.5, (1, 2), None), (15, 0.5, tuple(range(1, 9)), None), (32, 1.0, (3, 5), 6), (16, 1.0, (4,), 0)])
def test_table_and_arrays_agree(spark, case):
    table = triads(spark, *case).orderBy("triad_idx").toPandas()
    arrays = enumerate_triads(*case)
    for name, values in arrays.items():
        assert table[name].tolist() == values.tolist(), name
    assert table.triad_idx.tolist() == list(range(len(table)))


def test_overlaps_go_to_the_highest_region():
    t = enumerate_triads(16, 1.0, (1, 2), None)
    at = {(k, l): r for k, l, r in zip(t["k"].tolist(), t["l"].tolist(), t["region"].tolist())}
    assert at[(0, 0)] == 2 and at[(3, 0)] == 2 and at[(3, 3)] == 1 and at[(3, -3)] == 2


def test_lookup():
    t = enumerate_triads(16, 1.0, (1, 2), 4)
    i = find_triad(t, 16, 3, -2)
    assert (t["k"][i], t["l"][i]) == (3, -2)
    with pytest.raises(ValueError, match="off the frequency axis"):
        find_triad(t, 16, 8, 0)
    with pytest.raises(ValueError, match="not among"):
        find_triad(t, 16, -3, 2)
