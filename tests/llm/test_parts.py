"""Rows between the parts of op4 grow with the parts, not with their square."""

import numpy as np

from voxelspark.llm import op4_substrings as O


def test_rows_between_parts_grow_with_the_parts():
    ids = np.arange(20_000)
    made = lambda parts: parts * O.deal_out(ids, ids, ids, ids, O.receivers(parts)).num_rows
    assert made(8 * 844) <= 8 * made(844) <= 8 * 844 * O.RECEIVERS
