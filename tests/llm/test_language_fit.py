"""The language model's fit: ridge regression as defined, in bounded memory."""

import tracemalloc

import numpy as np

from intervale.llm import language_id


def test_the_fit_is_ridge_regression_within_little_more_than_its_examples():
    rng = np.random.default_rng(1)
    x = rng.random((400, 1 << language_id.BUCKET_BITS), dtype=np.float32)
    x /= x.sum(1, keepdims=True)
    y, codes = np.sort(rng.integers(0, 3, 400)), language_id.codewords(3)
    tracemalloc.start()
    weights, bias, margins = language_id.ridge(x, y, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes  # examples in double precision alone are twice that

    weight = np.sqrt(len(y) / (3 * np.bincount(y)))[y][:, None]
    scale = 1 / np.sqrt(x.mean(0, dtype=np.float64) + 1e-5)
    z = np.hstack([x * scale, np.ones((len(x), 1))]) * weight
    ridge = language_id.RIDGE * (z * z).sum() / len(z)
    w = z.T @ np.linalg.solve(z @ z.T + ridge * np.eye(len(z)), codes[y] * weight)
    assert np.allclose(weights, w[:-1] * scale[:, None], rtol=1e-4, atol=1e-5) and np.allclose(bias, w[-1]) and np.allclose(margins, z / weight @ w)
