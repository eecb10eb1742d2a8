"""Python workers serve many tasks, of one operator after another.  What an operator remembers in a
worker is given up when another one's task comes in, so that memories don't add up."""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def enter(operator: str, forget: Callable[[], None] | None = None) -> None:
    """To be called as a task begins.  ``forget`` gives up what this operator will remember."""
    for name in [n for n in _held if n != operator]:
        _held.pop(name)()
    if forget is not None:
        _held[operator] = forget


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = "4m"


def bound_batches(spark) -> None:
    """Bounds the batches that Spark hands to Python by bytes, as texts may be very long; holds for the
    session.  A row that is larger is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
