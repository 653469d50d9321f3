import pytest

from clickfeat.operators.combos import feature_combinations, normalise_combos
from clickfeat.plans.features import feature_manifest, manifest_names
from clickfeat.schema import as_keys, gap_name, range_count_name, unique_count_name


def test_power_set_sizes_and_order():
    allc = feature_combinations()
    assert len(allc) == 31
    assert allc[:5] == (("ip",), ("app",), ("device",), ("os",), ("channel",))
    assert allc[5] == ("ip", "app")
    assert allc[-1] == ("ip", "app", "device", "os", "channel")
    with_ip = feature_combinations(include=["ip"])
    assert len(with_ip) == 16 and all("ip" in c for c in with_ip)
    assert with_ip[15] == ("ip", "app", "device", "os", "channel")


def test_power_set_bounds():
    assert len(feature_combinations(min_n=2, max_n=3)) == 20
    with pytest.raises(ValueError):
        feature_combinations(max_n=6)
    with pytest.raises(ValueError):
        feature_combinations(min_n=3, max_n=2)


def test_keys_normalised():
    assert as_keys("ip") == ("ip",)
    assert normalise_combos("ip") == (("ip",),)
    assert normalise_combos([("ip", "app")]) == (("ip", "app"),)


def test_manifest_sizes():
    m = feature_manifest()
    assert [len(m[k]) for k in m] == [5, 6, 62, 75, 16, 16]
    names = manifest_names()
    assert len(names) == 180 and len(set(names)) == 180


def test_names():
    assert gap_name(("ip", "app"), "forward") == "ip_app_dt_forward"
    assert range_count_name(("ip",), 0, 3600) == "count_groupby_ip_in_time_range_0_3600_seconds"
    assert unique_count_name("app", ("ip",)) == "unique_count_app_groupby_ip"
    m = feature_manifest()
    # objectives in name order within each combination
    assert m["unique_count"][:4] == ["unique_count_app_groupby_ip", "unique_count_channel_groupby_ip",
                                     "unique_count_device_groupby_ip", "unique_count_os_groupby_ip"]
    assert m["time_delta"][:2] == ["ip_dt_forward", "ip_dt_backward"]
