"""Replaying a request log through per-minute token buckets.

A bucket is sequential, but what a stretch of requests does to it is a function of the level it
starts with, and that function has few pieces. So the log is cut into time slices: every slice
is summarized on its own, the summaries are chained per key (one small row per slice), and every
slice is replayed on its own from its known start. A key with most of the requests is spread
over as many tasks as it has slices.

Levels are whole numbers: one token is ``period`` microseconds, and a bucket of ``capacity``
tokens gains ``capacity`` units a microsecond. The level is stored as ``level - capacity * time``,
which waiting does not change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import is_blank, trim_controls
from lorewell.scale import cut_lineage

MINUTE = 60_000_000
FULL = 2**62

# Routes with their bucket names and requests per minute.
CHAT_PREFIX, LOGIN_PATH, ADMIN_PREFIX = "/api/chat/", "/api/admin/auth/login", "/api/admin/"
LIMITS = {"chat_ip": 60, "chat_session": 30, "admin_ip": 20, "login_ip": 5}


def request_keys(path: Column, ip: Column, session: Column, limits: dict[str, int] | None = None) -> dict[str, Column]:
    """Bucket keys and capacities of a request; null where no bucket applies."""
    limits = {**LIMITS, **(limits or {})}
    chat, login, admin = path.startswith(CHAT_PREFIX), path == LOGIN_PATH, path.startswith(ADMIN_PREFIX)
    return {
        "ip_key": F.when(chat, F.concat(F.lit("chat:ip:"), ip)).when(login, F.concat(F.lit("admin-login:ip:"), ip))
        .when(admin, F.concat(F.lit("admin:ip:"), ip)),
        "ip_capacity": F.when(chat, limits["chat_ip"]).when(login, limits["login_ip"]).when(admin, limits["admin_ip"]),
        "session_key": F.when(chat & ~is_blank(session), F.concat(F.lit("chat:session:"), trim_controls(session))),
        "session_capacity": F.when(chat & ~is_blank(session), limits["chat_session"]),
    }


def _step(pieces: list[tuple], time: int, capacity: int, period: int) -> list[tuple]:
    """Follow one request. A piece (low, high, shift, constant) maps start levels low..high."""
    top = capacity * period - capacity * time
    enough = period - capacity * time
    out: list[tuple] = []

    def put(low: int, high: int, shift: int, constant: int | None) -> None:
        if low > high:
            return
        if out and out[-1][2] == shift and out[-1][3] == constant:
            low = out.pop()[0]
        out.append((low, high, shift, constant))

    for low, high, shift, constant in pieces:
        if constant is not None:
            level = min(constant, top)
            put(low, high, 0, level - period if level >= enough else level)
            continue
        # Start levels up to ``full`` stay below the rim; those up to ``short`` lack a token.
        full, short = min(high, top + shift), min(high, enough + shift - 1)
        put(low, min(short, full), shift, None)
        put(max(low, short + 1), full, shift + period, None)
        put(max(low, full + 1), high, 0, top - period if top >= enough else top)
    return out


def _summaries(period: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pieces, rows = None, [], []

        def flush() -> None:
            if key is not None:
                rows.append((*key, *[list(part) for part in zip(*[
                    (p[0], p[1], p[2], p[3] is not None, p[3] or 0) for p in pieces])]))

        for batch in batches:
            for k, s, t, c in zip(*[batch[n].tolist() for n in ("bucket_key", "slice", "micros", "capacity")]):
                if (k, s) != key:
                    flush()
                    key, pieces = (k, s), [(-c * t, FULL, 0, None)]
                pieces = _step(pieces, t, c, period)
            yield pd.DataFrame(rows, columns=["bucket_key", "slice", "low", "high", "shift", "fixed", "constant"])
            rows = []
        flush()
        yield pd.DataFrame(rows, columns=["bucket_key", "slice", "low", "high", "shift", "fixed", "constant"])

    return run


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, level = None, FULL
    for batch in batches:
        starts = []
        for row in batch.itertuples(index=False):
            if row.bucket_key != key:
                key, level = row.bucket_key, FULL
            starts.append(level)
            for low, high, shift, fixed, constant in zip(row.low, row.high, row.shift, row.fixed, row.constant):
                if low <= level <= high:
                    level = int(constant) if fixed else level - int(shift)
                    break
        yield batch[["bucket_key", "slice"]].assign(start=starts)


def _replay(period: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, level = None, FULL
        for batch in batches:
            allowed = []
            for k, s, t, c, start in zip(*[batch[n].tolist() for n in (
                    "bucket_key", "slice", "micros", "capacity", "start")]):
                if (k, s) != key:
                    key, level = (k, s), start
                level = min(level, c * period - c * t)
                passed = level >= period - c * t
                level -= period if passed else 0
                allowed.append(passed)
            yield pd.DataFrame({"request_id": batch["request_id"], "allowed": allowed})

    return run


def token_bucket(requests: DataFrame, period: int = MINUTE, slice_micros: int | None = None) -> DataFrame:
    """(request_id, allowed) for requests (request_id, bucket_key, micros, capacity), by time then id."""
    width = slice_micros or 10 * period
    sliced = (
        requests.select("request_id", "bucket_key", "micros", F.col("capacity").cast("long").alias("capacity"))
        .withColumn("slice", F.floor(F.col("micros") / width)))
    ordered = sliced.repartition("bucket_key", "slice").sortWithinPartitions("bucket_key", "slice", "micros", "request_id")
    summaries = ordered.mapInPandas(
        _summaries(period),
        "bucket_key string, slice long, low array<long>, high array<long>, shift array<long>, "
        "fixed array<boolean>, constant array<long>")
    starts = summaries.repartition("bucket_key").sortWithinPartitions("bucket_key", "slice").mapInPandas(
        _starts, "bucket_key string, slice long, start long")
    # By a hash of the join's columns: Spark leaves out a repartition by the columns themselves, and then may split large partitions
    # of the join, so that several tasks would replay one slice.
    return (
        sliced.join(starts, ["bucket_key", "slice"])
        .repartition(F.xxhash64("bucket_key", "slice"))
        .sortWithinPartitions("bucket_key", "slice", "micros", "request_id")
        .mapInPandas(_replay(period), f"request_id {requests.schema['request_id'].dataType.simpleString()}, allowed boolean"))


def rate_limit_replay(requests: DataFrame, limits: dict[str, int] | None = None, period: int = MINUTE,
                      slice_micros: int | None = None) -> DataFrame:
    """Add ``allowed`` to requests (request_id, ts, path, ip, session).

    ``slice_micros`` bounds what one task replays of a bucket; make it smaller for busier buckets.
    The address bucket is charged first; a session bucket only sees what passed it.
    """
    keyed = requests.withColumns({
        **request_keys(F.col("path"), F.col("ip"), F.col("session"), limits),
        "__micros": F.unix_micros(F.col("ts").cast("timestamp"))})

    def through(rows: DataFrame, kind: str) -> DataFrame:
        charged = rows.where(F.col(f"{kind}_key").isNotNull()).select(
            "request_id", F.col(f"{kind}_key").alias("bucket_key"), F.col("__micros").alias("micros"),
            F.col(f"{kind}_capacity").alias("capacity"))
        return token_bucket(charged, period, slice_micros).withColumnRenamed("allowed", f"__{kind}")

    # The first pass feeds the second and the result: settle its two small columns once.
    by_ip = keyed.join(cut_lineage(through(keyed, "ip")), "request_id", "left").withColumn("__ip", F.coalesce("__ip", F.lit(True)))
    passed = by_ip.where("__ip")
    by_session = by_ip.join(through(passed, "session"), "request_id", "left")
    return by_session.withColumn("allowed", F.col("__ip") & F.coalesce("__session", F.lit(True))).select(
        *requests.columns, "allowed")
