"""Geometry, bitmaps, entries, the store and the generated predicate: no Spark."""

import random
import re

import pytest

from skiplight.functions.bitmaps import VectorBitmap, unsigned
from skiplight.geometry import Geometry
from skiplight.operators.store import CacheEntry, CacheKey, CacheStats, CacheStore
from skiplight.plans.pruning import IN_LIMIT, joined_runs, pruning_predicate, runs_of

G = Geometry()


def entry(groups, geometry=G):
    e = CacheEntry(geometry)
    for g, vectors in groups.items():
        e.ensure_group(g)
        for v in vectors:
            e.set_vector(g, v)
    return e


def test_geometry():
    assert G.vectors_per_group == 60
    assert (G.total_groups(500_000), G.total_vectors(500_000)) == (5, 245)
    assert (G.total_groups(130_000), G.total_vectors(130_000)) == (2, 64)
    assert list(G.groups_of_range(122_879, 2)) == [0, 1]
    assert list(G.groups_of_range(5, 0)) == []
    for bad in ((100, 33), (0, 1), (10, 0)):
        with pytest.raises(ValueError):
            Geometry(*bad)


def test_bitmap():
    b = VectorBitmap(60)
    assert b.is_empty() and not b.has(0)
    b.set(0)
    b.set(59)
    b.set(59)
    assert b.has(0) and b.has(59) and not b.has(1) and b.count() == 2 and b.positions() == [0, 59]
    for bad in (60, -1):
        with pytest.raises(IndexError):
            b.set(bad)
        with pytest.raises(IndexError):
            b.has(bad)
    c = VectorBitmap(60)
    c.set(7)
    b.merge(c)
    assert b.positions() == [0, 7, 59]
    assert unsigned(-1) == (1 << 64) - 1 and unsigned(-(1 << 63)) == 1 << 63


def test_entry():
    e = entry({0: [0, 5], 1: [], 2: [10]})
    assert e.group_count() == 3 and e.has_group(1) and not e.has_group(3)
    assert e.passes(0, 5) and not e.passes(0, 1) and not e.passes(1, 0) and e.passes(9, 0)
    assert not e.vector_matches(9, 0) and e.vector_matches(2, 10)
    assert e.group_is_empty(1) and not e.group_is_empty(0) and not e.group_is_empty(9)
    assert e.range_is_empty(122_880, 200_000) and not e.range_is_empty(0, 100) and not e.range_is_empty(245_760, 245_770)
    assert not e.range_is_empty(None, None) and not e.range_is_empty(122_880, 3 * 122_880)
    assert e.stats(300_000) == CacheStats(3, 147, 2, 3)
    e.merge(e)
    e.merge(entry({1: [3], 4: [1]}))
    assert e.passes(1, 3) and e.has_group(4)
    assert e.erase([0, 7]) == (1, False) and e.erase([1, 2, 4]) == (3, True)


def test_store():
    s = CacheStore()
    a, b, c = CacheKey(1, "val > 5"), CacheKey(1, "val < 2"), CacheKey(2, "val > 5")
    assert s.lookup(a) is None
    with pytest.raises(ValueError):
        s.upsert(a, None)
    for k in (a, b, c):
        s.upsert(k, entry({0: [1], 1: [2]}))
    s.upsert(b, entry({0: [1]}))
    assert s.filter_keys(1) == {"val > 5", "val < 2"} and s.has_entries(2)
    assert s.remove_groups(1, [0]) == 2
    assert s.lookup(b) is None and s.lookup(a).snapshot() == {1: 4} and s.lookup(c).group_count() == 2
    assert s.remove_groups(1, [1]) == 1 and not s.has_entries(1) and s.remove_groups(1, [1]) == 0
    s.remove_table(2)
    assert len(s) == 0
    s.upsert(a, entry({0: [1]}))
    s.clear()
    assert s.lookup(a) is None and not s.has_entries(1)


def test_store_evicts_the_least_recently_used():
    s = CacheStore(budget_bytes=3 * entry({0: [1]}).size_bytes())
    keys = [CacheKey(1, str(i)) for i in range(4)]
    for k in keys[:3]:
        s.upsert(k, entry({0: [1]}))
    s.lookup(keys[0])
    s.upsert(keys[3], entry({0: [1]}))
    assert s.lookup(keys[1]) is None and s.lookup(keys[0]) and s.filter_keys(1) == {"0", "2", "3"}


def holds(sql, g, v):
    return eval(sql.replace("__rg", str(g)).replace("__vid", str(v)).replace("AND", "and").replace("OR", "or").replace(" = ", " == ").replace("IN (", "in (0.5, ").replace("false", "False"))


@pytest.mark.parametrize("per,size", [(16, 512), (128, 64), (1, 4)])
def test_predicate_keeps_what_must_be_read(per, size):
    rng = random.Random(per)
    geometry = Geometry(per * size, size)
    for _ in range(60):
        live = sorted(rng.sample(range(12), rng.randint(1, 12)))
        bitmaps = {g: rng.choice([0, (1 << per) - 1, rng.getrandbits(per)]) for g in live if rng.random() < 0.8}
        sql = pruning_predicate(bitmaps, live, geometry)
        for g in live:
            for v in range(per):
                must = g not in bitmaps or bitmaps[g] >> v & 1
                kept = sql is None or holds(sql, g, g * per + v)
                assert kept or not must
                if not must and sql and "__vid" in sql:
                    assert not kept
    assert pruning_predicate({0: 0}, [0], geometry) == "false"
    assert pruning_predicate({}, [0, 1], geometry) is None
    assert pruning_predicate({}, [], geometry) is None


def test_predicate_is_bounded():
    geometry = Geometry(4096 * 4, 4)
    bits = sum(1 << i for i in range(0, 4096, 2))
    sql = pruning_predicate({0: bits, 1: 0}, [0, 1], geometry)
    assert sql.count(" OR ") < 500 and "__rg" in sql
    assert all(holds(sql, 0, v) for v in range(0, 4096, 2))
    # 5,000 scattered vectors: the nearest are joined, all are kept, and most of the others still fall away
    wide, chosen = Geometry(200_000 * 4, 4), sorted(random.Random(1).sample(range(200_000), 5000))
    sql = pruning_predicate({0: sum(1 << v for v in chosen)}, [0], wide)
    low = [tuple(map(int, x)) for x in re.findall(r"__vid >= (\d+) AND __vid <= (\d+)", sql)]
    single = {int(x) for part in re.findall(r"IN \(([^)]*)\)", sql) for x in part.split(", ")}
    held = single | {v for a, b in low for v in range(a, b + 1)}
    assert held >= set(chosen) and len(low) + len(single) <= 500 and len(held) < 170_000
    assert joined_runs([(0, 1), (5, 6), (8, 8), (20, 30)], 2) == [(0, 8), (20, 30)]
    few = sum(1 << 2 * i for i in range(IN_LIMIT))
    assert "__vid IN" in pruning_predicate({0: few}, [0], geometry)
    assert runs_of([3, 1, 2, 7]) == [(1, 3), (7, 7)]
