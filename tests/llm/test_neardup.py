"""Near-duplicates against brute force: by default all of them at any size, and the recall of bands."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import neardup


@pytest.fixture(scope="module")
def planted(spark):
    """Vectors, and pairs just above the threshold."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((1000, 64)))
    side = rng.standard_normal((1000, 64))
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    x = np.concatenate([a, 0.9505 * a + np.sqrt(1 - 0.9505**2) * side])
    links = np.argwhere(np.triu(unit(x) @ unit(x).T >= 0.95, 1))
    return spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), links


def test_every_pair_at_any_size(planted, monkeypatch):
    monkeypatch.setattr(neardup, "plan", lambda n, threshold: (9, 3))  # as for many vectors, but leaky
    vectors, links = planted
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(vectors).collect()}
    n = np.bincount(links.ravel(), minlength=len(got))
    assert len(links) >= 1000 and [got[i][0] for i in range(len(got))] == n.tolist()
    assert all(got[a][1] == got[b][1] for a, b in links.tolist())


@pytest.mark.parametrize("shape", [(5, 8), (9, 15)])
def test_recall_of_bands(planted, shape):
    vectors, links = planted
    found = sum(r["n_links"] for r in neardup.near_duplicates(vectors, shape=shape).collect()) / 2
    print(f"recall of {shape}: {found / len(links)}")
    assert 0.99 * len(links) <= found <= len(links)
