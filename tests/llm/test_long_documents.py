"""Mixes of sources whose documents are longer than the dynamic program's table."""

from __future__ import annotations

import numpy as np


def test_long_documents_are_taken_where_they_fit():
    from tideframe.llm.mixing import fit_counts

    for lengths, counts, budget, want in (([100_000], [3], 130_000, 100_000), ([90_000, 100_000], [1, 1], 120_000, 100_000), ([5, 100_000], [4, 3], 130_000, 100_020)):
        take = fit_counts(np.array(lengths), np.array(counts), budget)
        assert (take <= counts).all() and int((take * np.array(lengths)).sum()) == want
