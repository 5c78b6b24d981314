"""Elements of a small product are counted alike whether or not they fit one number with their owner."""

import numpy as np
import pytest

from reviewtrust.operators import compare as C


@pytest.mark.parametrize("span", [50, 1 << 62])
def test_shared_elements_of_any_span(span):
    rng = np.random.default_rng(3)
    owners, elements = rng.integers(0, 9, 400), rng.integers(0, 50, 400)
    elements = elements * (span // 50)
    sets = [set(elements[owners == k].tolist()) for k in range(9)]
    sizes, together = C._shared(owners, elements, 9, span)
    assert sizes.tolist() == [len(s) for s in sets]
    assert all(together[a, b] == len(sets[a] & sets[b]) for a in range(9) for b in range(a))
    none = np.zeros(0, np.int64)
    assert C._shared(none, none, 3, span)[0].tolist() == [0, 0, 0]
