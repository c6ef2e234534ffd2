"""Rules for the fields of a trace event."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tests.handmade import START
from tillwork.functions import requests as rq
from tillwork.operators.requests import dedupe_events, normalize_requests
from tillwork.schemas import RAW_REQUESTS, SchemaMismatch, check


def column(spark, values, build, type="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {type}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_api_name(spark):
    cases = {
        "/api/v1/cart/7": "CartApi",
        "/api/v12/private/products?x=1": "ProductsApi",
        "/api/v1/auth/customer/profile": "CustomerApi",
        "/api/v1/auth": "AuthApi",
        "/api/v1/": "UnknownApi",
        "/api/cart": "UnknownApi",
        "/shop/api/v2/é": "ÉApi",
    }
    assert column(spark, list(cases), lambda c: rq.api_name(rq.api_resource(c))) == list(cases.values())


def test_error_type(spark):
    cases = {
        200: "", 204: "", 301: "", 100: "", 400: "BAD_REQUEST", 401: "UNAUTHORIZED", 403: "FORBIDDEN", 404: "NOT_FOUND",
        409: "CONFLICT", 418: "CLIENT_ERROR", 422: "UNPROCESSABLE_ENTITY", 429: "TOO_MANY_REQUESTS", 500: "SERVER_ERROR", 599: "SERVER_ERROR",
    }
    assert column(spark, list(cases), rq.error_type, "INT") == list(cases.values())


def token(claims: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(claims, ensure_ascii=False).encode()).decode().rstrip("=")


def test_token_user(spark):
    cases = {
        f"Bearer h.{token({'sub': 'ann'})}.s": "ann",
        f"bearer h.{token({'sub': ' ', 'user_name': 'bob'})}.s": "bob",
        f"BEARER h.{token({'username': 'cy', 'x': '??>>'})}": "cy",
        f"Bearer h.{token({'sub': 'ünï'})}.s": "ünï",
        f"Basic h.{token({'sub': 'ann'})}.s": None,
        "Bearer nodots": None,
        "Bearer a.!!!!.c": None,
        "Bear": None,
    }
    headers = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i INT, h STRING")
    claims = headers.withColumn("c", rq.token_claims("h"))
    fields = claims.select("i", *[rq.json_text_field("c", name).alias(name) for name in rq.TOKEN_CLAIMS])
    got = fields.orderBy("i").select(rq.first_filled(*rq.TOKEN_CLAIMS)).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_json_field_takes_the_first_string_even_in_cut_text(spark):
    cases = {
        '{"username": "a"}': "a",
        '{"x":1,"username":"a\\"b","username":"c"}': 'a\\"b',
        '{"username":"cut of': "cut of",
        '{"username":""}': "",
        '{"user":"a"}': "",
    }
    assert column(spark, list(cases), lambda c: rq.json_text_field(c, "username")) == list(cases.values())


RAW = dict(
    event_id="e", received_at=START, method="GET", uri="/api/v1/cart/1", query_string=None, status=200, header_request_id=None,
    header_client_id=None, header_session_id=None, header_authorization=None, server_session_id=None, principal=None,
    content_type=None, body=None,
)


def events(spark, *changes):
    rows = [{**RAW, "event_id": f"e{i}", **c} for i, c in enumerate(changes)]
    raw = spark.createDataFrame([tuple(r[f.name] for f in RAW_REQUESTS.fields) for r in rows], RAW_REQUESTS)
    return normalize_requests(raw).orderBy("event_id").collect()


def test_user_falls_back_step_by_step(spark):
    body = '{"emailAddress":"a@b.c"}'
    got = events(
        spark,
        dict(principal="ann", header_authorization=f"Bearer h.{token({'sub': 'bob'})}.s"),
        dict(principal="anonymousUser", header_authorization=f"Bearer h.{token({'sub': 'bob'})}.s"),
        dict(uri="/api/v1/customer/register", body=body, header_session_id="S"),
        dict(uri="/api/v1/customer", body=body, header_session_id="S"),
        dict(server_session_id="T"),
        dict(),
    )
    assert [r.user_id for r in got] == ["ann", "bob", "a@b.c", "anon:S", "anon:T", "anonymous"]
    assert [r.session_id for r in got] == ["", "", "S", "S", "T", ""]


def test_payload(spark):
    got = events(
        spark,
        dict(body='{"a":1}', content_type="application/JSON; charset=utf-8", query_string="x=1"),
        dict(body="a=1", content_type="text/plain", query_string='q="a\\b"'),
        dict(body="", content_type="application/json"),
        dict(body="x" * 20000, content_type="application/json"),
        dict(body="é" * 9000, content_type="application/json"),
        dict(body="x" + "é" * 9000, content_type="application/json"),
    )
    payloads = [r.payload for r in got]
    assert payloads[:3] == ['{"a":1}', '{"query":"q=\\"a\\\\b\\""}', ""]
    assert payloads[3] == "x" * 16384
    assert payloads[4] == "é" * 8192
    # The cut goes through a character: what is left of it becomes a replacement mark.
    assert payloads[5] == "x" + "é" * 8191 + "�"


def test_made_request_ids_repeat_and_differ(spark):
    first = [r.request_id for r in events(spark, {}, {}, dict(header_request_id="given"), dict(header_request_id=" "))]
    again = [r.request_id for r in events(spark, {}, {}, dict(header_request_id="given"), dict(header_request_id=" "))]
    assert first == again and len(set(first)) == 4 and first[2] == "given"
    assert [len(p) for p in first[0].split("-")] == [8, 4, 4, 4, 12]


def test_only_api_requests_become_events(spark):
    assert [r.endpoint for r in events(spark, dict(uri="/shop/x"), dict(uri="/api/v1/x", method="PUT"))] == ["PUT /api/v1/x"]


def test_batch_clean_up_keeps_each_id_once(shop):
    events = shop["api_performance"]
    assert dedupe_events(events.union(events)).count() == events.count()


def test_schema_check_names_what_is_wrong(spark):
    df = spark.createDataFrame([], "event_id STRING, received_at STRING")
    with pytest.raises(SchemaMismatch, match="received_at is string, not timestamp.*uri is missing"):
        check(df, RAW_REQUESTS)


@pytest.mark.parametrize("size", [5_000, 100_000, 10_000_000])
def test_json_text_field_of_any_length(spark, size):
    value = "ab\\\\" * (size // 4)
    texts = [f'{{"username":"{value}","x":1}}', f'{{"username":"{value}', f'{{"username":"{value}\\']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(rq.json_text_field("t", "username").alias("v"))
    assert [r.n for r in df.select(F.length("v").alias("n")).collect()] == [len(value)] * 3
