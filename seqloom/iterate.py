"""The driver loop of fixpoint algorithms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: str, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """Apply ``step`` until no row of the new state has ``changed`` true.

    Every state is written to the shared folder, so the plan of a round does not grow
    with the rounds before it. Returns the last state (with ``changed``) and the
    number of rounds; with ``max_rounds`` it may stop before, and the caller looks at
    ``changed``. Convergence is one scan of the state just written.
    """
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        state = cut(step(state, rounds), "round")
        rounds += 1
        if state.where(F.col(changed)).isEmpty():
            break
    return state, rounds
