"""Decision rules of the key profile (no Spark needed)."""
from clickfeat.operators.folds import bucket_chars_for
from clickfeat.operators.skew import KeyProfile, forced_profile


def _profile(**kw):
    base = dict(total_rows=10 ** 9,
                distinct={"ip": 300_000, "app": 700, "device": 3_000, "os": 800, "channel": 200},
                max_group={"ip": 50_000_000, "app": 1_000, "device": 900_000_000, "os": 5_000, "channel": 9_000},
                min_second=0, max_second=4 * 86400 - 1, hot_rows=2_000_000, broadcast_rows=1_000_000,
                min_root_distinct=400)
    base.update(kw)
    return KeyProfile(**base)


def test_hot_and_thin_keys_never_root():
    p = _profile()
    assert not p.good_root("ip")        # one ip holds 50 M rows: hot
    assert not p.good_root("device")    # one device holds most rows: hot
    assert not p.good_root("channel")   # 200 values cannot feed 400 tasks
    assert p.good_root("app") and p.good_root("os")


def test_root_choice_prefers_most_values():
    p = _profile()
    assert p.root_for(("ip", "app", "os")) == "os"     # os 800 values > app 700
    assert p.root_for(("ip", "device")) is None         # no safe key: reduced plan
    assert p.root_for(("app", "channel")) == "app"


def test_small_input_any_key_roots():
    p = _profile(total_rows=100_000, max_group={k: 50_000 for k in ("ip", "app", "device", "os", "channel")})
    assert all(p.good_root(k) for k in ("ip", "app", "device", "os", "channel"))


def test_broadcast_bound_is_a_product_of_exact_counts():
    p = _profile()
    assert p.group_bound(("app",)) == 700 and p.can_broadcast(("app",))
    assert p.group_bound(("app", "channel")) == 140_000 and p.can_broadcast(("app", "channel"))
    assert not p.can_broadcast(("device", "os"))                      # 2.4 M
    assert not p.can_broadcast(("app",), with_seconds=True)           # 700 x 345,600 seconds
    assert p.group_bound(("ip", "app", "device", "os", "channel")) == 10 ** 9  # capped by the rows


def test_forced_profiles():
    assert forced_profile("window").root_for(("os", "ip")) == "os"
    assert forced_profile("second").root_for(("ip",)) is None
    assert forced_profile("second", broadcast=True).can_broadcast(("ip", "app"))
    assert not forced_profile("second").can_broadcast(("ip",))


def test_bucket_width_grows_with_sqrt_rows():
    assert [bucket_chars_for(n) for n in (1, 70_000, 10 ** 6, 10 ** 12)] == [1, 3, 3, 5]
