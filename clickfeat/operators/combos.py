"""Feature combinations (power set of id columns) and their planning order."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from ..schema import ID_COLUMNS, as_keys


def feature_combinations(cols: Sequence[str] = ID_COLUMNS, min_n: int = 1, max_n: int | None = None,
                         include: Iterable[str] = ()) -> tuple[tuple[str, ...], ...]:
    """All combinations of ``cols`` with ``min_n..max_n`` members, by size then position,
    keeping only those that hold every column of ``include``."""
    cols = list(cols)
    if max_n is None:
        max_n = len(cols)
    if max_n > len(cols):
        raise ValueError(f"cannot choose {max_n} of {len(cols)} columns")
    if max_n < min_n:
        raise ValueError(f"no size lies between {min_n} and {max_n}")
    need = set(as_keys(include)) if include else set()
    out = []
    for n in range(min_n, max_n + 1):
        for combo in itertools.combinations(cols, n):
            if need <= set(combo):
                out.append(combo)
    return tuple(out)


def normalise_combos(combos) -> tuple[tuple[str, ...], ...]:
    """Accept one combination or many; a bare string is one single-key combination."""
    if isinstance(combos, str):
        return (as_keys(combos),)
    combos = list(combos)
    if combos and all(isinstance(c, str) for c in combos):
        # a flat list of names is ambiguous; treat each name as its own combination
        return tuple(as_keys(c) for c in combos)
    return tuple(as_keys(c) for c in combos)
