"""Raw requests into trace events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions import requests as q
from tillwork.schemas import RAW_REQUESTS, check


def normalize_requests(raw: DataFrame) -> DataFrame:
    """One event per API request; works on a batch and on a stream.

    No shuffle, no state. Costly parts (patterns, the token) are columns of an
    inner projection, so each is worked out once per row however often it is used.
    """
    check(raw, RAW_REQUESTS, "raw requests")
    claims = {f"_claim_{name}": name for name in q.TOKEN_CLAIMS}
    fields = {f"_field_{name}": name for name in q.SIGN_IN_FIELDS}
    prepared = (
        raw.where(F.col("uri").startswith("/api/"))
        .withColumns(
            {
                "_session": q.session_id("header_session_id", "server_session_id"),
                "_resource": q.api_resource("uri"),
                "_claims": q.token_claims("header_authorization"),
                "_sign_in": q.sign_in_body("uri", "body"),
            }
        )
        .withColumns(
            {column: q.json_text_field("_claims", name) for column, name in claims.items()}
            | {column: q.json_text_field("_sign_in", name) for column, name in fields.items()}
        )
    )
    return prepared.select(
        "event_id",
        q.request_id("header_request_id", "event_id").alias("request_id"),
        F.col("received_at").alias("event_timestamp"),
        q.api_name("_resource").alias("api_name"),
        F.concat_ws(" ", "method", "uri").alias("endpoint"),
        F.col("status").cast("string").alias("status_code"),
        q.error_type("status").alias("error_type"),
        q.user_id("principal", [F.col(c) for c in (*claims, *fields)], "_session").alias("user_id"),
        q.client_id("header_client_id").alias("client_id"),
        F.col("_session").alias("session_id"),
        q.payload("body", "content_type", "query_string").alias("payload"),
    )


def dedupe_events(events: DataFrame) -> DataFrame:
    """Each event id once; the clean-up of a batch of events."""
    return events.dropDuplicates(["event_id"])
