"""The order of n-gram hashes in a batch."""

import numpy as np

from veilspark.llm.backoff_lm import ordered


def test_order_of_hashes_is_the_stable_one():
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 2**64, 5000, np.uint64)
    for values in (wide[rng.integers(0, 50, 3000)], wide, wide >> np.uint64(53), (wide & np.uint64(2**9 - 1)) | (wide >> np.uint64(62) << np.uint64(62)), wide[:1], wide[:2], np.full(9, 2**64 - 1, np.uint64)):
        order, out = ordered(values)
        expected = np.argsort(values, kind="stable")
        assert (order == expected).all()
        assert (out == values[expected]).all()
