"""Rate limits on requests: the window opens with the first request of a key, and closes a fixed time later.

The state of a key is its open window: two numbers. Streams and tables go through the same machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.hashing import key_prefix
from riskframe.limits import IP_LIMIT, IP_WINDOW_S, KEY_LIMIT, KEY_WINDOW_S
from riskframe.streaming import machines

_STATE = "start long, n long, until long"


def decide(times_ms: list[int], state: tuple[int, int] | None, limit: int, window_ms: int) -> tuple[list[tuple[bool, int]], tuple[int, int] | None]:
    """(allowed, retry after ms) of requests in the order of time, and the state (start, count) after them.

    A request that is older than the open window belongs to a window that is gone and is let through,
    as a store that fails would let it."""
    out = []
    for t in times_ms:
        if state is not None and t < state[0]:
            out.append((True, 0))
            continue
        if state is None or t >= state[0] + window_ms:
            state = (t, 0)
        state = (state[0], state[1] + 1)
        ok = state[1] <= limit
        out.append((ok, 0 if ok else state[0] + window_ms - t))
    return out, state


def window_step(limit: int, window_ms: int) -> machines.Step:
    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        ((ok, wait),), (start, n) = decide([row["ms"]], None if state is None else (state["start"], state["n"]), limit, window_ms)
        return {"start": start, "n": n, "until": start + window_ms}, [{"request_id": row["request_id"], "allowed": ok, "retry_after_s": wait / 1000}]

    return step


def rate_limit(requests: DataFrame, key: Column, limit: int, window_s: int, delay: str, settle: bool = True) -> DataFrame:
    """Requests (request_id, ts) with limit_key, allowed and retry_after_s. Requests without a key are allowed.

    A stream with ``settle`` answers once the watermark has passed a request, and then as a table of all requests
    would; without it at once, in the order of arrival."""
    rows = requests.select("request_id", "ts", key.alias("limit_key"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    out = f"request_id {kinds['request_id']}, limit_key {kinds['limit_key']}, allowed boolean, retry_after_s double"
    step, columns, order = window_step(limit, window_s * 1000), ["request_id"], ["request_id"]
    if requests.isStreaming:
        decided = machines.stream(rows, "limit_key", columns, order, _STATE, out, step, delay=delay, settle=settle)
    else:
        decided = machines.batch(rows, "limit_key", columns, order, out, step)
    free = rows.where("limit_key IS NULL").select("request_id", "limit_key", F.lit(True).alias("allowed"), F.lit(0.0).alias("retry_after_s"))
    return decided.unionByName(free)


def limit_by_ip(requests: DataFrame, limit: int = IP_LIMIT, window_s: int = IP_WINDOW_S, settle: bool = True) -> DataFrame:
    return rate_limit(requests, F.col("client_ip"), limit, window_s, "1 minute", settle)


def limit_by_key(requests: DataFrame, limit: int = KEY_LIMIT, window_s: int = KEY_WINDOW_S, settle: bool = True) -> DataFrame:
    """By the hash prefix of the token; requests without a token are left to the limit by address."""
    with_token = requests.where(F.coalesce("token", F.lit("")) != "")
    return rate_limit(with_token, key_prefix(F.col("token")), limit, window_s, "5 minutes", settle)


def limit_both(requests: DataFrame, ip_limit: int = IP_LIMIT, ip_window_s: int = IP_WINDOW_S, key_limit: int = KEY_LIMIT, key_window_s: int = KEY_WINDOW_S) -> DataFrame:
    """A table of requests (request_id, ts, client_ip, token) with allowed, refused_by and retry_after_s: first the limit by
    address; what passes it and has a token counts for the token's limit too."""
    by_ip = limit_by_ip(requests, ip_limit, ip_window_s).drop("limit_key")
    passed = requests.join(by_ip.where("allowed").select("request_id"), "request_id", "left_semi")
    by_key = limit_by_key(passed, key_limit, key_window_s).select("request_id", F.col("allowed").alias("_ok"), F.col("retry_after_s").alias("_wait"))
    both = by_ip.join(by_key, "request_id", "left")
    ok = F.coalesce("_ok", F.lit(True))
    return both.select("request_id", (F.col("allowed") & ok).alias("allowed"), F.when(~F.col("allowed"), "ip").when(~ok, "key").alias("refused_by"), F.when(F.col("allowed"), F.coalesce("_wait", F.lit(0.0))).otherwise(F.col("retry_after_s")).alias("retry_after_s"))


def window_counts(requests: DataFrame, key: str, limit: int, window_s: int) -> DataFrame:
    """The report variant, for batch and stream: clock-aligned windows with the number of requests over the limit."""
    per = requests.groupBy(F.window("ts", f"{window_s} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("window_start"), key, "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))
