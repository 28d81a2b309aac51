"""Exact top-k where the query's id has many rows."""

import random

import numpy as np
import pytest

from docloom.llm import topk


@pytest.mark.parametrize("copies", [2, 8])
def test_own_rows_take_no_place(copies):
    rng = random.Random(copies)
    for _ in range(20):
        rows = np.array([[rng.randint(-200, 200) for _ in range(4)] for _ in range(300)], np.float64)
        ids = np.arange(300)
        rows[:copies], ids[:copies] = rows[0] * 3, 0
        order = np.argsort(rows, axis=0, kind="stable").T.copy()
        best, _ = topk.threshold_topk(rows[0], 0, rows, ids, order, 5)
        want = sorted(((int(r @ rows[0]), int(i)) for r, i in zip(rows, ids, strict=True) if i != 0), key=lambda x: (-x[0], x[1]))[:5]
        assert best == want
