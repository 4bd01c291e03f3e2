"""Keyed event processing with Structured Streaming; batch twins are in operators.catalog and operators.sequences.

Idempotency, sessions and rate limits keep the states of the batch operators, as JSON, and take their steps.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioquarry.operators.ordered import micros
from folioquarry.operators.sequences import idempotency_step, keyed_requests, rate_step

DAY = 86_400_000  # milliseconds


def timed(events: DataFrame, late: str) -> DataFrame:
    """events with a watermark: state is dropped by event time, and events more than `late` behind are not taken in."""
    return events.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", late)


def forget_after(state: GroupState, last: pd.Timestamp, milliseconds: int) -> None:
    state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + milliseconds, state.getCurrentWatermarkMs() + 1))


def keyed(events: DataFrame, key: str, columns: tuple[str, ...], step: Callable, keep: int, late: str, answer: str = "answer") -> DataFrame:
    """(id, answer): events (received_at, id, `columns`; at first) through step(state, values) by key; a batch's events of a key
    are taken by time and id. A key without an event for `keep` milliseconds is forgotten."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(["received_at", "id"])  # one key's events of one micro-batch
        said = []
        for values in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in columns), strict=True):
            held, what = step(held, values)
            said.append(what)
        state.update((json.dumps(held),))
        forget_after(state, pdf["received_at"].max(), keep)
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), answer: said})

    kind = events.schema["id"].dataType.simpleString()
    return timed(events, late).groupBy(key).applyInPandasWithState(run, f"id {kind}, {answer} string", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def payment_decisions(events: DataFrame, keep_days: int = 30, late: str = "1 day") -> DataFrame:
    """events: payment_id, id, received_at, signature_valid, amount_matches, provider_success. A payment's state is whether
    it is decided; bad events fail, the first good one decides, later ones are ignored. A payment without an event for
    `keep_days` days is forgotten, so the state doesn't grow for ever; nulls in the flags count as false."""

    def step(decided: bool | None, event: tuple) -> tuple[bool, str]:
        payment, valid, matches, success = event
        if not valid:
            said = "BAD_SIGNATURE"
        elif not matches:
            said = "AMOUNT_MISMATCH"
        elif decided:
            said = "IGNORED"
        else:
            decided, said = True, "SUCCESS" if success else "FAILED"
        return bool(decided), f"{payment} {said}"

    flags = {c: F.coalesce(c, F.lit(False)) for c in ("signature_valid", "amount_matches", "provider_success")}
    out = keyed(events.withColumns(flags), "payment_id", ("payment_id", *flags), step, keep_days * DAY, late)
    parts = F.split("answer", " ")
    return out.select("id", parts[0].cast("long").alias("payment_id"), parts[1].alias("outcome"))


def answered_requests(events: DataFrame, ttl: int = 3600, late: str = "10 minutes") -> DataFrame:
    """events and answers as sequences.idempotency() says, whose faulty events are dropped here; a key is forgotten `ttl` seconds
    after its last event."""
    rows = keyed_requests(events).where("_fault IS NULL").withColumn("at", micros("received_at"))
    return keyed(rows, "_key", ("at", "kind", "request_hash", "request"), idempotency_step(ttl), ttl * 1000, late)


def first_requests(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The first request of each idempotency key within the time to live. The watermark is a choice made here."""
    return events.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", ttl).dropDuplicatesWithinWatermark(["idempotency_key"])


def rate_limited(events: DataFrame, cooldown: int = 60, most: int = 5, window: int = 86_400, late: str = "1 hour") -> DataFrame:
    """events: user_id, id, received_at; (id, answer) as sequences.rate_limits() says, whose events without a time are dropped
    here. A user who sends nothing for twice the window is forgotten."""
    rows = events.where("received_at IS NOT NULL").withColumns({"at": micros("received_at"), "user_id": F.coalesce(F.col("user_id").cast("string"), F.lit(""))})
    return keyed(rows, "user_id", ("at",), rate_step(cooldown, most, window), 2 * window * 1000, late)
