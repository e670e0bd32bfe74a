"""Requests as a stream: intents and outcomes in any order, expiry by timers, and the same end as the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tasks import RELEASED, RESERVED, SETTLED, SUBMITTED

#: A row for each change of a request: its state, its cost once it ends, and why it changed.
CHANGES = "idempotency_key string, state int, cost_usd double, reason string"
#: Spark keeps such state in RocksDB only.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def folded(outcomes: list[tuple[int, str, float | None]]) -> tuple[int, float | None]:
    """State and cost of a reservation after outcomes (seq, outcome, usd), taken in the order of seq; one that does not fit changes nothing."""
    state, cost = RESERVED, None
    for _, what, usd in sorted(outcomes, key=lambda x: x[0]):
        if state == RESERVED and what == "submitted":
            state = SUBMITTED
        elif state == SUBMITTED and what == "done":
            state, cost = SETTLED, usd
        elif state in (RESERVED, SUBMITTED) and what == "rejected":
            state, cost = RELEASED, 0.0
    return state, cost


class Requests(StatefulProcessor):
    """Holds what is known of each request until it ends, and a timer until it expires.

    Rows (idempotency_key, seq, outcome, usd) of one request may come in any order and more than
    once: 'intent' reserves it, the others are outcomes. They are kept by seq and folded anew, so that a late
    earlier outcome counts as if it had come in time. A request that is reserved, but not
    submitted, ``expires_ms`` after its intent is released.
    """

    def __init__(self, expires_ms: int):
        self.expires_ms = expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.intent = handle.getValueState("intent", "seq bigint")
        self.seen = handle.getMapState("seen", "seq bigint", "outcome string, usd double")
        self.last = handle.getValueState("last", "state int, expired boolean")

    def _known(self) -> list[tuple[int, str, float | None]]:
        return [(k[0], v[0], v[1]) for k, v in self.seen.iterator()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = self.intent.exists()
        for part in rows:
            for seq, what, usd in zip(part["seq"].tolist(), part["outcome"].tolist(), part["usd"].tolist(), strict=True):
                if what == "intent":
                    if not self.intent.exists():
                        self.intent.update((int(seq),))
                else:
                    self.seen.updateValue((int(seq),), (what, None if pd.isna(usd) else float(usd)))
        if not self.intent.exists():
            return  # outcomes wait for their intent
        if not begun and self.expires_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expires_ms)
        state, cost = folded(self._known())
        before = self.last.get() if self.last.exists() else None
        if before is not None and before[1] and state == RESERVED:
            return  # expired, and nothing says otherwise
        if before is None or before[0] != state or before[1]:
            self.last.update((state, False))
            yield pd.DataFrame([(key[0], state, cost, "intent" if before is None and state == RESERVED else "outcome")], columns=["idempotency_key", "state", "cost_usd", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] == RESERVED:
            self.last.update((RELEASED, True))
            yield pd.DataFrame([(key[0], RELEASED, 0.0, "expired")], columns=["idempotency_key", "state", "cost_usd", "reason"])

    def close(self) -> None:
        pass


def request_changes(events: DataFrame, *, expires_ms: int = 0) -> DataFrame:
    """The changes (CHANGES) of requests from a stream of events (idempotency_key, seq, outcome, usd); 0: nothing expires.

    The session needs the settings of PROVIDER. State is kept until a request is known no
    more; the last change of each request is what ``tasks.settle`` says of all its outcomes.
    """
    return events.groupBy("idempotency_key").transformWithStateInPandas(Requests(expires_ms), CHANGES, "update", "processingTime" if expires_ms else "none")  # with timers a query goes on without data
