"""Gradient steps of operator 9: sums by table row that are exact and cheap."""

import time

import numpy as np
import pytest

from kestrel.llm import lm


@pytest.mark.parametrize("tokens, features, size", [(0, 2, 9), (1, 1, 1), (1000, 4, 7), (5000, 2, 1 << 20), (16384, 4, 1 << 17), (777, 3, 70_000)])
def test_rows_are_summed_whatever_repeats(tokens, features, size):
    rng = np.random.default_rng(tokens + size)
    index = np.minimum(rng.zipf(1.3, (tokens, features)) - 1, size - 1).astype(np.int64)
    values = rng.normal(size=(tokens, lm.CLASSES)).astype(np.float32)
    want = np.zeros((size, lm.CLASSES))
    np.add.at(want, index, values.astype(float)[:, None, :])
    room = np.full((3, max(1, tokens * features // 2), lm.CLASSES), np.nan, np.float32)
    for buffers in (None, room):
        touched, sums = lm._add_rows(index, values, size, buffers)
        assert sorted(touched) == sorted(set(index.ravel()))
        assert np.allclose(sums, want[touched], atol=2e-3, rtol=1e-4)
    if size == 7:
        assert np.allclose(lm._add_few(index[:, 0], values, size), [values[index[:, 0] == k].astype(float).sum(axis=0) for k in range(size)], atol=1e-3)


def test_softmax_of_large_and_tiny_logits():
    z = np.array([[1000, 999, -1000], [-500, -500, -501], [0, 1, 2]], np.float32)
    e = np.exp(z.astype(float) - z.max(axis=1, keepdims=True))
    assert np.allclose(lm._softmax(z.copy()), e / e.sum(axis=1, keepdims=True), atol=1e-6)
    assert np.allclose(lm._softmax(z[2:].copy()), (e / e.sum(axis=1, keepdims=True))[2:], atol=1e-6)
    assert lm._softmax(np.empty((0, 3), np.float32)).shape == (0, 3)


def test_a_step_costs_less_than_sums_of_sorted_segments():
    """op9's CPU seconds a GB: most of training was the sum of gradients by segments of a sorted copy."""
    rng = np.random.default_rng(5)
    size = 1 << 17
    index = np.minimum(rng.zipf(1.3, (lm.STEP_TOKENS, 4)) - 1, size - 1).astype(np.int32)
    values = rng.normal(size=(lm.STEP_TOKENS, lm.CLASSES)).astype(np.float32)

    def by_segments():
        flat = index.T.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.nonzero(np.diff(flat[order], prepend=-1))[0]
        return np.add.reduceat(values[order % len(values)], first, axis=0)

    def least(run):
        found = []
        for _ in range(7):
            at = time.process_time()
            run()
            found.append(time.process_time() - at)
        return min(found)
    assert least(lambda: lm._add_rows(index, values, size)) < 0.8 * least(by_segments)
