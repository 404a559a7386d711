"""Vectors that lie near most borders, and so would be guests almost everywhere."""

import numpy as np
import pandas as pd

from permeon.llm import embdedup


def spread(n: int) -> np.ndarray:
    return embdedup.unit(np.random.default_rng(4).standard_normal((n, 64)))


def test_guests_stay_few():
    x = spread(8_000)
    centroids = embdedup.fitted(x[:4_000], 400)
    assert 1 < len(centroids) < 400
    assert embdedup.cells_of(x[4_000:], centroids)[1].sum(1).mean() < 1.2 * embdedup.GUESTS


def test_dealt_vectors_are_handed_on_in_parts():
    x, centroids = spread(2_000), spread(300)[:200]
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "copies": 1, "embedding": list(x)})
    tables = list(embdedup._deal({64: centroids})(iter([frame])))
    sizes = [t["data"].map(len).sum() for t in tables]
    assert len(sizes) > 1 and max(sizes) < 2 * embdedup.SENT_BYTES
    home, guest = embdedup.cells_of(x, centroids)
    assert sum(t["rows"].sum() for t in tables) == len(x) + guest.sum()


def test_single_precision_loses_no_link():
    """Pairs at the threshold, within what single precision can't tell apart, in several parts of a comparison."""
    n, rng = 1_500, np.random.default_rng(6)
    a = spread(n)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = embdedup.COSINE + 1e-9 * np.where(np.arange(n) % 2, 1, -1)[:, None]
    x = np.concatenate((a, cosine * a + np.sqrt(1 - cosine**2) * side))
    none = np.zeros((len(x), 1), bool)
    held = embdedup.Vectors([embdedup.Vectors.packed(np.arange(len(x)), np.ones(len(x), int), np.zeros(len(x)), none, x)], 1)
    out = embdedup.compare(0, held, None)
    assert sorted(out["vec_id"]) == [*range(1, n, 2), *range(n + 1, 2 * n, 2)]
    assert (out["n"] == 1).all() and (out["other"] == out["vec_id"] % n).all()
