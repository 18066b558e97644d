import random

import numpy as np
import pytest

from graphloom.llm import induced as I


def check(values):
    text = np.array(values, np.uint16)
    size = int(text.max()) + 1 if len(text) else 1
    found = list(I.suffixes_descending(text, size))
    at = np.concatenate([a for a, _ in found]) if found else np.empty(0, int)
    lcp = np.concatenate([c for _, c in found]) if found else np.empty(0, int)
    suffix = [tuple(values[i : i + I.DEPTH]) for i in range(len(values))]
    assert sorted(at.tolist()) == list(range(len(values)))
    ordered = [suffix[i] for i in at.tolist()]
    assert all(a >= b for a, b in zip(ordered, ordered[1:]))
    for k in range(1, len(ordered)):
        a, b = ordered[k - 1], ordered[k]
        common = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == common, (k, lcp[k], common)
    if len(lcp):
        assert lcp[0] == 0


@pytest.mark.parametrize("sigma", [1, 2, 3, 20])
@pytest.mark.parametrize("spill", [False, True])
def test_order_and_common_prefixes(monkeypatch, sigma, spill):
    if spill:
        monkeypatch.setattr(I, "BUFFER", 3)
        monkeypatch.setattr(I, "CHUNK", 5)
    rng = random.Random(sigma)
    for n in (0, 1, 2, 3, 10, 60, 300):
        for _ in range(4):
            check([rng.randrange(sigma) for _ in range(n)])
    block = [rng.randrange(sigma) for _ in range(70)]
    check(block * 3 + [0] + block)
    check([1] * 130 + [0] + [1] * 130)
