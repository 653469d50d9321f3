"""Roots of one to three keys: the choice, the exact profile behind it, equal results and fewer exchanges."""

import collections
import itertools

import pytest

from clickfeat.operators.combos import feature_combinations
from clickfeat.operators.gaps import click_gaps
from clickfeat.operators.skew import KeyProfile, forced_profile, profile_key_sets, profile_keys
from clickfeat.plans.features import feature_table
from clickfeat.plans.queries import ALL, Inputs
from clickfeat.schema import ID_COLUMNS

from conftest import SF_SMALL


def profile(hot, distinct=1000, pair=10_000, **kw):
    sets = {s: (pair, 1000) for n in (2, 3) for s in itertools.combinations(ID_COLUMNS, n)}
    return KeyProfile(total_rows=10**9, distinct={k: distinct for k in ID_COLUMNS}, max_group={k: 10**8 if k in hot else 1000 for k in ID_COLUMNS},
                      min_second=0, max_second=10**6, min_root_distinct=400, **{"sets": sets, **kw})


def test_safe_single_keys_root_everything():
    roots = profile(()).roots(ALL)
    assert {len(r) for r in roots.values()} == {1} and len(set(roots.values())) == 5
    assert len(set(profile(()).roots([c for c in ALL if "ip" in c]).values())) == 1


def test_every_key_hot_takes_pairs():
    """26 combinations hang on ten pairs; only the single keys are reduced."""
    roots = profile(ID_COLUMNS).roots(ALL)
    assert {c for c, r in roots.items() if r is None} == {(k,) for k in ID_COLUMNS}
    assert {len(r) for r in roots.values() if r} == {2} and len({r for r in roots.values() if r}) == 10
    assert all(set(r) <= set(c) for c, r in roots.items() if r)


def test_hot_pairs_give_way_to_triples():
    p = profile(ID_COLUMNS)
    p.sets = {s: (10_000, 10**8 if len(s) == 2 else 1000) for s in p.sets}
    roots = p.roots(ALL)
    assert {len(c) for c, r in roots.items() if r is None} == {1, 2} and {len(r) for r in roots.values() if r} == {3}


def test_only_sets_that_could_help_are_counted():
    p = profile(("ip", "device"), sets={})
    assert p.uncounted_sets(ALL) == [("ip", "device")]
    assert p.uncounted_sets([("ip", "app")]) == [] and profile((), sets={}).uncounted_sets(ALL) == []
    assert len(profile(ID_COLUMNS, sets={}).uncounted_sets(ALL)) == 20 and forced_profile("second").uncounted_sets(ALL) == []


@pytest.fixture(scope="module")
def union(spark):
    return Inputs(spark, SF_SMALL).union.select("row_id", *ID_COLUMNS, "click_time_int_seconds").cache()


def test_the_profile_of_sets_is_exact(spark, union):
    rows = [tuple(r) for r in union.select(*ID_COLUMNS).collect()]
    p = profile_key_sets(union, profile_keys(union, hot_rows=1), ALL)
    assert len(p.sets) == 20
    for s, got in p.sets.items():
        n = collections.Counter(tuple(r[ID_COLUMNS.index(k)] for k in s) for r in rows)
        assert got == (len(n), max(n.values())), s


def hot(union, **kw):
    """Every single key is hot, most pairs are not."""
    p = profile_keys(union)
    return profile_keys(union, hot_rows=min(p.max_group.values()) - 1, broadcast_rows=0, min_root_distinct=1, **kw)


def test_rooted_on_sets_equals_the_window_plan(union):
    fams = ("time_delta", "unique_count", "count_groupby_0_21600")
    p = hot(union)
    roots = profile_key_sets(union, p, ALL).roots(ALL)
    assert 1 < len({r for r in roots.values() if r and len(r) > 1})
    got, want = (sorted(map(tuple, feature_table(union, fams, profile=q, keep=("row_id",)).collect())) for q in (p, forced_profile("window")))
    assert got == want


def test_half_the_exchanges_when_every_key_is_hot(union, monkeypatch):
    def exchanges(p):
        return click_gaps(union, ALL, profile=p)._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    rooted = exchanges(hot(union))
    monkeypatch.setattr(KeyProfile, "uncounted_sets", lambda *a: [])
    reduced = exchanges(hot(union))
    assert rooted <= reduced / 2, (rooted, reduced)
