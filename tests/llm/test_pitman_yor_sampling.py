"""The sampler does the whole of its sweeps: two of burn-in before the kept ones, over sixteen turns."""

import numpy as np

from tessera.llm import pitman_yor as py


def test_sweeps_and_turns():
    assert py.BURN_IN == 2 and py.TURNS == 16
    drawn = []

    class Rng:
        def integers(self, low, high, size):
            drawn.append(high - low)
            return np.zeros(size, np.int64)

        def random(self, size):
            return np.zeros(size)

    py.seat(np.array([1, 1]), np.zeros(2, int), np.array([0.5, 0.5]), 0.5, 1.0, Rng())
    assert drawn == [16]
