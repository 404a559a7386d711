"""Exchangeability: variance groups by exact vectors, permutations by what they may move."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from permeon.exchange import permutations, signs, variance_groups

A = np.array


# Labels, flags and the variance groups that they have to give.
@pytest.mark.parametrize(
    ("eb", "flags", "expected"),
    [
        (np.ones(6, int), {}, [1] * 6),
        (A([1, 1, 2, 2, 3, 3]), {"within": False, "whole": False}, [1] * 6),
        (A([1, 1, 1, 2, 2, 2]), {"within": True, "whole": True}, [1] * 6),
        (A([[1, i] for i in range(1, 7)]), {}, [1] * 6),
        (A([[-1, 5]] * 3), {}, [1, 1, 1]),
        (A([10, 10, 10, 10, 20, 20, 20]), {}, [1, 1, 1, 1, 2, 2, 2]),
        (A([3, 1, 3, 1, 3, 1]), {"within": True, "whole": False}, [2, 1, 2, 1, 2, 1]),
        (A([[-1, 1], [-1, 1], [-1, 2], [-1, 2], [-1, 3], [-1, 3]]), {}, [1, 1, 2, 2, 3, 3]),
        (A([[-2, 10], [-2, 10], [-2, 5], [-2, 5], [-2, 8], [-2, 8]]), {}, [3, 3, 1, 1, 2, 2]),
        (A([1, 1, 1, 2, 2, 2]), {"within": False, "whole": True}, [1, 2, 3, 1, 2, 3]),
        (A([1, 2, 1, 2, 1, 2]), {"within": False, "whole": True}, [1, 1, 2, 2, 3, 3]),
        (A([[10, 1], [10, 1], [10, 2], [10, 2], [10, 3], [10, 3]]), {}, [1, 2, 1, 2, 1, 2]),
        (A([[1, -1, 1], [1, -1, 2], [1, -2, 1], [1, -2, 2], [1, -3, 1], [1, -3, 2]]), {}, [1, 2, 1, 2, 1, 2]),
        (A([]), {}, []),
        (np.empty((0, 2)), {}, []),
        (A([5]), {}, [1]),
        (A([[1, 5]]), {}, [1]),
        (A([2, 2, 2, 2]), {"within": True, "whole": False}, [1] * 4),
        (A([2, 2, 2, 2]), {"within": False, "whole": True}, [1] * 4),
        (A([1.0, 1.0, 2.0, 2.0]), {}, [1, 1, 2, 2]),
    ],
)
def test_variance_groups(eb, flags, expected):
    assert variance_groups(eb, **flags).tolist() == expected


@pytest.mark.parametrize(
    ("eb", "flags", "error"),
    [
        (A([1, 1, 2]), {"within": False, "whole": True}, "same size"),
        (A([[1, 1], [1, 1], [1, 2]]), {}, "same size"),
        (A([1.0, 1.5, 2.0]), {}, "non-integer"),
        (A(["a", "b", "a"]), {}, "integer-like"),
        (np.array(5), {}, "0-dimensional"),
        (A([[1, 1], [-1, 2], [1, 3]]), {}, "mixed signs in first column"),
    ],
)
def test_variance_group_errors(eb, flags, error):
    with pytest.raises(ValueError, match=error):
        variance_groups(eb, **flags)


def test_lists_are_no_labels():
    with pytest.raises(TypeError):
        variance_groups([1, 2])


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 30), st.integers(0, 5), st.integers(0, 10))
def test_free_is_a_bijection(n, count, seed):
    drawn = list(permutations(n, count, seed=seed))
    assert len(drawn) == count and all(sorted(p) == list(range(n)) for p in drawn)


def test_within_and_whole():
    eb = A([1, 1, 2, 2, 3, 3])
    for p in permutations(6, 50, eb, seed=12345):
        assert (eb[p] == eb).all()
    seen = set()
    for p in permutations(6, 50, eb, whole=True, seed=12345):
        assert all(p[i + 1] == p[i] + 1 for i in (0, 2, 4))
        seen.add(tuple(p))
    assert len(seen) > 1
    interleaved = A([1, 2, 1, 2])
    assert all((interleaved[p] == interleaved).all() for p in permutations(4, 20, interleaved, seed=1))
    with pytest.raises(ValueError, match="same size"):
        list(permutations(5, 1, A([1, 1, 1, 2, 2]), whole=True))
    assert len({tuple(p) for p in permutations(6, 50, eb, within=True, whole=True, seed=1)}) > 30


def test_multi_level():
    b = A([1, 1, 2, 2, 3, 3])
    ones = np.ones(6, int)
    assert all((b[p] == b).all() for p in permutations(6, 50, np.stack([-ones, b], 1), seed=1))
    both = list(permutations(6, 50, np.stack([ones, b], 1), seed=1))
    assert all(b[p][0] == b[p][1] and b[p][2] == b[p][3] for p in both)
    assert any(p[0] > p[1] for p in both)
    fixed = list(permutations(6, 50, np.stack([ones, -b, A([1, 2, 3, 4, 5, 6])], 1), seed=1))
    assert all(p[i + 1] == p[i] + 1 for p in fixed for i in (0, 2, 4)) and len({tuple(p) for p in fixed}) > 1
    for bad in (A([[1, 0]] * 4), A([[1, 1], [-1, 2], [1, 1], [1, 2]])):
        with pytest.raises(ValueError):
            list(permutations(4, 1, bad))
    with pytest.raises(ValueError):
        list(permutations(4, 1, A([1, 2, 3])))


def test_signs():
    groups = A([1, 1, 2, 2])
    for s in signs(4, 10, groups, seed=3):
        assert set(s) <= {-1, 1} and s[0] == s[1] and s[2] == s[3]
