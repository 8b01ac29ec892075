"""Links within one pair of blocks, as counts and spanning edges instead of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd


def spanning_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """(first member, member) for each component of a symmetric link matrix."""
    open_, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not open_[start]:
            continue
        open_[start] = False
        edge = np.array([start])
        while len(edge):
            reached = np.flatnonzero(linked[edge].any(axis=0) & open_)
            open_[reached] = False
            out += [(start, int(i)) for i in reached]
            edge = reached
    return out


def link_rows(ids: np.ndarray, weight: np.ndarray, counted: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """Rows of one kind: ``id``, ``n`` (links) or ``id``, ``to`` (an edge of the forest).

    ``counted`` marks the ordered pairs whose links are counted here, ``linked`` all links
    seen here. ``weight`` is how many rows a member stands for.
    """
    n = counted @ weight
    edges = spanning_edges(linked)
    have = np.flatnonzero(n)
    return pd.DataFrame(
        {
            "id": np.concatenate([ids[have], ids[[b for _, b in edges]]]) if edges or len(have) else np.array([], np.int64),
            "to": pd.array([None] * len(have) + [int(ids[a]) for a, _ in edges], "Int64"),
            "n": np.concatenate([n[have], np.zeros(len(edges))]).astype(np.int64),
        }
    )
