"""Rules that are settled one event after another: idempotency keys, reading sessions, rate limits.

Spark's frames can't say "an hour from whichever event became the holder", so events are dealt out by key, sorted within
their partition and streamed through a small state: a key's events are never held together, and a key is taken in order
by one task. Equal moments are taken by id. The steps are plain functions; streaming.callbacks keeps the same states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.operators.ordered import micros

SECOND, MINUTE = 1_000_000, 60_000_000


def streamed(events: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...], step: Callable[[Any, tuple], tuple[Any, tuple]], answers: str) -> DataFrame:
    """(id, answers) of each event: step(state, values of columns) gives the next state and the answers; a key begins at None.
    answers: their names and types as a schema."""
    names = [x.split()[0] for x in answers.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for pdf in frames:
            said = []
            values = (pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in columns)
            for row in zip(pdf["_key"].tolist(), *values, strict=True):
                if not begun or row[0] != now:
                    now, state, begun = row[0], None, True
                state, what = step(state, row[1:])
                said.append(what)
            out = pd.DataFrame(said, columns=names, dtype=object)
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out.astype({n: "Int64" for n, x in zip(names, answers.split(", "), strict=True) if x.endswith(" long")})

    rows = events.select(F.col(key).alias("_key"), "id", *[c for c in columns if c != "id"])
    dealt = rows.repartition("_key").sortWithinPartitions("_key", *order)
    return dealt.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, {answers}")


# Idempotency


def idempotency_step(ttl: int) -> Callable[[dict | None, tuple], tuple[dict | None, str]]:
    """state: expires, hash and status of what is stored, and the hashes of requests that are running. A request that finds
    nothing stored runs and is stored as PROCESSING; its end is stored, with its own time to live, whatever is there then."""

    def step(state: dict | None, event: tuple) -> tuple[dict | None, str]:
        at, kind, what, request = event
        state = state or {"expires": None, "running": {}}
        alive = state["expires"] is not None and at < state["expires"]
        if kind in ("COMPLETED", "FAILED"):
            hash_ = state["running"].pop(str(request), None)
            if hash_ is None:
                return state, "UNKNOWN_REQUEST"
            return state | {"expires": at + ttl * SECOND, "hash": hash_, "status": kind}, "STORED"
        if not alive:
            return {"expires": at + ttl * SECOND, "hash": what, "status": "PROCESSING", "running": state["running"] | {str(request): what}}, "NEW"
        if state["hash"] != what:
            return state, "CONFLICT"
        return state, {"COMPLETED": "REPLAY", "FAILED": "REPLAY_FAILURE", "PROCESSING": "IN_PROGRESS"}[state["status"]]

    return step


def keyed_requests(events: DataFrame) -> DataFrame:
    """events as idempotency() takes them, with _key (the scope and the trimmed key as JSON) and their fault, if any."""
    has = lambda c, kind="string": F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
    key = F.trim("idempotency_key")
    kind = F.coalesce(has("kind"), F.lit("BEGIN"))
    fault = (
        F.when(F.coalesce(key, F.lit("")) == "", "KEY_REQUIRED").when(F.col("received_at").isNull(), "TIME_REQUIRED")
        .when(~kind.isin("BEGIN", "COMPLETED", "FAILED"), "UNKNOWN_KIND")
    )
    scope = F.to_json(F.struct(has("actor_id").alias("a"), has("method").alias("m"), has("path").alias("p"), key.alias("k")))
    request = F.when(kind == "BEGIN", F.col("id").cast("string")).otherwise(has("request_id"))
    return events.select(
        "id", "received_at", scope.alias("_key"), kind.alias("kind"), F.coalesce("request_hash", F.lit("")).alias("request_hash"),
        request.alias("request"), fault.alias("_fault"),
    )


def idempotency(events: DataFrame, ttl: int = 3600) -> DataFrame:
    """events: id, idempotency_key, request_hash, received_at and, if there are any, actor_id, method, path (the key's scope),
    kind and request_id. (id, answer) of each.

    A request (kind BEGIN, or none) is NEW if nothing is stored under its key in its scope; then it is stored for `ttl` seconds.
    Otherwise it is a CONFLICT if its hash is another, IN_PROGRESS while the stored one runs, REPLAY after it COMPLETED and
    REPLAY_FAILURE after it FAILED. Events of these two kinds name the request that ended (request_id); its end is STORED for
    `ttl` seconds from then, UNKNOWN_REQUEST if that one never ran. A blank key is KEY_REQUIRED, a null time TIME_REQUIRED,
    another kind UNKNOWN_KIND: none of these changes anything. Null hashes are equal to each other, null scopes, too."""
    rows = keyed_requests(events).withColumn("at", micros("received_at"))
    step = idempotency_step(ttl)
    answers = streamed(
        rows.where("_fault IS NULL"), "_key", ("at", "id"), ("at", "kind", "request_hash", "request"), lambda s,
        e: (lambda r: (r[0], (r[1],)))(step(s, e)), "answer string",
    )
    return answers.unionByName(rows.where("_fault IS NOT NULL").select("id", F.col("_fault").alias("answer")))


# Reading sessions


ACTIONS = ("OPEN", "REFRESH", "READ", "CLOSE", "REVOKE")


def session_step(ttl: int, throttle: int, url_ttl: int) -> Callable[[dict | None, tuple], tuple[dict | None, tuple]]:
    """state: owner, loan's end, session's end, last written heartbeat, status. Moments are microseconds."""

    def step(state: dict | None, event: tuple) -> tuple[dict | None, tuple]:
        at, action, member, loan_end = event
        if state is None:
            if action != "OPEN":
                return None, ("READING_SESSION_NOT_FOUND", None, None, False)
            if loan_end is None:
                return None, ("EBOOK_LOAN_REQUIRED", None, None, False)
            end = min(at + ttl * MINUTE, loan_end)
            return {"owner": member, "loan_end": loan_end, "end": end, "written": at, "status": "ACTIVE"}, ("ACTIVE", end, None, True)
        if member != state["owner"] and action != "REVOKE":
            return state, ("READING_SESSION_FORBIDDEN", None, None, False)
        if state["status"] == "ACTIVE" and state["end"] <= at:
            state = state | {"status": "EXPIRED"}
        if action in ("CLOSE", "REVOKE"):
            if state["status"] == "ACTIVE":
                state = state | {"status": "CLOSED" if action == "CLOSE" else "REVOKED"}
            return state, (state["status"], None, None, False)
        if state["status"] != "ACTIVE":
            return state, ("READING_SESSION_NOT_ACTIVE", None, None, False)
        if action == "READ":
            return state, ("ACTIVE", state["end"], min(at + url_ttl * MINUTE, state["end"]), False)
        writes = state["written"] < at - throttle * MINUTE
        state = state | {"end": min(at + ttl * MINUTE, state["loan_end"]), "written": at if writes else state["written"]}
        return state, ("ACTIVE", state["end"], None, writes)

    return step


def with_loan_end(events: DataFrame, ebook_loans: DataFrame) -> DataFrame:
    """events with _loan_end: the end of the loan of their member and e-book that is ACTIVE, has begun and ends last."""
    l = ebook_loans.where("status = 'ACTIVE'").select(
        F.col("member_id").alias("_lm"), F.col("ebook_id").alias("_le"), F.col("borrowed_at").alias("_from"), F.col("expired_at").alias("_until"),
    )
    rows = events.select("*", F.monotonically_increasing_id().alias("_row"))
    inside = (F.col("member_id") == F.col("_lm")) & (F.col("ebook_id") == F.col("_le")) & (F.col("_from") <= F.col("at")) & (F.col("_until") > F.col("at"))
    found = rows.where("action = 'OPEN'").join(l, inside).groupBy("_row").agg(F.max("_until").alias("_loan_end"))
    return rows.join(found, "_row", "left").drop("_row")


def moment(c: str) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def reading_sessions(events: DataFrame, ebook_loans: DataFrame, ttl: int = 15, throttle: int = 5, url_ttl: int = 5) -> DataFrame:
    """events: id, session_id, member_id, ebook_id, action, at. (id, code, session_expires_at, url_expires_at, wrote) of each.

    A session begins with its first OPEN that finds a loan (EBOOK_LOAN_REQUIRED without one) and ends `ttl` minutes later, at
    the loan's end at most. REFRESH, or another OPEN, moves the end likewise and writes a heartbeat if the last written one is
    more than `throttle` minutes old. READ gives an address for `url_ttl` minutes, to the session's end at most. CLOSE and
    REVOKE end a session and say its state; of one that has ended already they change nothing. Others are refused:
    READING_SESSION_NOT_FOUND, READING_SESSION_FORBIDDEN (another member's; REVOKE is for anyone), READING_SESSION_NOT_ACTIVE
    (ended before or at this moment). Events without a session, a time or a known action get BAD_REQUEST."""
    bad = F.col("session_id").isNull() | F.col("at").isNull() | ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    rows = events.select("id", "session_id", "member_id", "ebook_id", "action", "at")
    good = with_loan_end(rows.where(~bad), ebook_loans).withColumns({"_t": micros("at"), "_loan_end": micros("_loan_end")})
    answers = streamed(
        good, "session_id", ("_t", "id"), ("_t", "action", "member_id", "_loan_end"), session_step(ttl, throttle, url_ttl),
        "code string, end long, url long, wrote boolean",
    )
    out = answers.select("id", "code", moment("end").alias("session_expires_at"), moment("url").alias("url_expires_at"), "wrote")
    null = F.lit(None).cast("timestamp_ntz")
    return out.unionByName(rows.where(bad).select("id", F.lit("BAD_REQUEST").alias("code"), null.alias("session_expires_at"), null.alias("url_expires_at"), F.lit(False).alias("wrote")))


# Rate limits


def rate_step(cooldown: int, most: int, window: int) -> Callable[[dict | None, tuple], tuple[dict, str]]:
    def step(state: dict | None, event: tuple) -> tuple[dict, str]:
        (at,) = event
        begun, last, n = (state["begun"], state["last"], state["n"]) if state else (None, None, 0)
        if begun is None or at >= begun + window * SECOND:
            begun, n = None, 0
        if last is not None and at < last + cooldown * SECOND:
            said = "COOLDOWN"
        elif n >= most:
            said = "LIMIT"
        else:
            said, begun, last, n = "ALLOWED", at if begun is None else begun, at, n + 1
        return {"begun": begun, "last": last, "n": n}, said

    return step


def rate_limits(sends: DataFrame, cooldown: int = 60, most: int = 5, window: int = 86_400) -> DataFrame:
    """sends: id, user_id, received_at. ALLOWED unless within `cooldown` seconds of the last allowed one (COOLDOWN) or
    `most` were allowed in the `window` seconds that the first allowed one began (LIMIT). Null users are one user; a null
    time is TIME_REQUIRED and changes nothing."""
    rows = sends.select("id", F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("_user"), micros("received_at").alias("at"))
    step = rate_step(cooldown, most, window)
    answers = streamed(rows.where("at IS NOT NULL"), "_user", ("at", "id"), ("at",), lambda s, e: (lambda r: (r[0], (r[1],)))(step(s, e)), "answer string")
    return answers.unionByName(rows.where("at IS NULL").select("id", F.lit("TIME_REQUIRED").alias("answer")))
