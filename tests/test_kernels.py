"""Sequential kernels against brute force and literal cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tessera.functions import config
from tessera.operators import align, calibrate, kernels, quality, search


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (3, 2), (4, 4), (5, 6), (6, 4)])
def test_assignment_is_least_cost(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(25):
        cost = np.round(rng.random(shape), rng.integers(1, 6))
        got = kernels.assign_least_cost(cost)
        assert len(got) == min(shape) and len({i for i, _ in got}) == len({j for _, j in got}) == min(shape)
        r, c = shape
        small = cost if r <= c else cost.T
        best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_rescue_joins_blocks_and_cuts_off():
    """Objects 4 and 5 join their neighbours; 6's cluster already holds its session; 7 too."""
    sessions, labels = [0, 1, 0, 1, 2, 2, 1, 0], [0, 0, 1, 1, -1, -1, -1, -1]
    edges = [(0.1, 0, 1), (0.1, 2, 3), (0.2, 4, 0), (0.25, 5, 2), (0.3, 6, 0), (0.35, 7, 3)]
    found = kernels.rescue(list(zip(range(8), sessions, labels, strict=True)), edges, 0.5)
    assert [found[k][1] if found[k][0] == 0 else -1 for k in range(8)] == [0, 0, 1, 1, 0, 1, -1, -1]


def test_rescue_accepts_the_cutoff_itself_and_makes_new_clusters():
    found = kernels.rescue([(0, 0, -1), (1, 1, -1), (2, 2, -1)], [(0.5, 0, 1), (0.6, 1, 2)], 0.5)
    assert found == {0: (1, 0), 1: (1, 0), 2: (2,)}


def test_density_clusters_hold_one_object_a_session():
    rng = np.random.RandomState(42)
    nodes = [(s * 20 + k, s) for s in range(4) for k in range(20)]
    edges = []
    for s, t in itertools.combinations(range(4), 2):
        for a in range(20):
            for b in range(max(0, a - 2), min(20, a + 3)):
                sim = 0.8 + rng.rand() * 0.15 if a == b else 0.1 + rng.rand() * 0.2
                edges.append((1 - sim, s * 20 + a, t * 20 + b))
    found = kernels.density_clusters(nodes, edges, 2, 4, 1)
    groups: dict[int, list[int]] = {}
    for n, s in nodes:
        if found[n][0] >= 0:
            groups.setdefault(found[n][0], []).append(s)
    assert groups and all(len(g) > 1 and len(set(g)) == len(g) for g in groups.values())
    assert all(0 <= p <= 1 for _, p, _ in found.values())


def test_isotonic_never_falls_and_pools_by_weight():
    assert calibrate.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [1.0, 2.25, 2.25, 4.0]


def test_search_finds_a_minimum_and_repeats_itself():
    loss = lambda v: float(((v - np.array([0.3, -0.7])) ** 2).sum())
    a = search.differential_evolution(loss, [(-1, 1), (-1, 1)], generations=60)
    b = search.differential_evolution(loss, [(-1, 1), (-1, 1)], generations=60)
    assert a[1] < 1e-3 and a[0].tolist() == b[0].tolist()


def test_registration_recovers_a_shift_and_a_rotation():
    image = np.random.default_rng(0).random((32, 40))
    moved = np.roll(image, (-3, 5), (0, 1))
    assert align.translation(image, moved)[:2] == (3, -5)
    points = np.random.default_rng(1).random((12, 2)) * 50
    a = 0.4
    true = np.array([[np.cos(a), -np.sin(a), 3], [np.sin(a), np.cos(a), -2], [0, 0, 1]])
    target = (np.c_[points, np.ones(12)] @ true.T)[:, :2]
    assert np.allclose(align.procrustes(points, target), true)
    assert np.allclose(align.procrustes(points[:2], target[:2]), np.eye(3))
    target[:3] += 40
    found, inside = align.ransac(points, target)
    assert inside.sum() == 9 and np.allclose(found, true)


def test_adjusted_mutual_information_of_equal_and_unrelated_labels():
    assert quality.adjusted_mutual_information(np.diag([4.0, 5.0, 6.0])) == pytest.approx(1.0)
    assert abs(quality.adjusted_mutual_information(np.full((3, 3), 30.0))) < 0.05


def test_parameters_are_strict_and_completed():
    defaults = {"a": 1, "b": {"c": 2, "d": 3}}
    assert config.prepare({"b": {"c": 5}}, defaults) == {"a": 1, "b": {"c": 5, "d": 3}}
    with pytest.raises(KeyError, match=r"b\.x"):
        config.prepare({"b": {"x": 1}}, defaults)
    assert config.flatten(defaults) == {"a": 1, "b.c": 2, "b.d": 3}
