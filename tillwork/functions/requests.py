"""Fields of a trace event, worked out from one raw request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwork.functions.values import as_column, blank_to_null

# What the shop's events look like.
API_NAME_PATTERN = "/api/v\\d+/(?:private/|auth/)?([^/?]+)"
UNKNOWN_API = "UnknownApi"
NAMED_ERRORS = {
    400: "BAD_REQUEST",
    401: "UNAUTHORIZED",
    403: "FORBIDDEN",
    404: "NOT_FOUND",
    409: "CONFLICT",
    422: "UNPROCESSABLE_ENTITY",
    429: "TOO_MANY_REQUESTS",
}
OTHER_CLIENT_ERROR = "CLIENT_ERROR"
SERVER_ERROR = "SERVER_ERROR"
TOKEN_CLAIMS = ["sub", "user_name", "username"]
SIGN_IN_PATHS = ["/customer/login", "/customer/register", "/private/login"]
SIGN_IN_FIELDS = ["username", "emailAddress"]
ANONYMOUS = "anonymous"
PAYLOAD_BYTES = 16 * 1024


def api_resource(uri) -> Column:
    """First part of the path after the version: ``cart`` of ``/api/v1/private/cart/7``."""
    return F.regexp_extract(as_column(uri), API_NAME_PATTERN, 1)


def api_name(resource) -> Column:
    """``cart`` gives ``CartApi``."""
    resource = as_column(resource)
    named = F.concat(F.upper(F.substring(resource, 1, 1)), F.substr(resource, F.lit(2)), F.lit("Api"))
    return F.when(F.length(resource) > 0, named).otherwise(UNKNOWN_API)


def error_type(status) -> Column:
    """Name of the error a status code stands for; empty if it is none."""
    status = as_column(status)
    result = F.when(status >= 500, SERVER_ERROR).when(status >= 400, OTHER_CLIENT_ERROR).otherwise("")
    for code, name in NAMED_ERRORS.items():
        result = F.when(status == code, name).otherwise(result)
    return result


def json_text_field(text, field: str) -> Column:
    """The first string that follows ``"field":`` anywhere in the text, or ''.

    Deliberately a pattern and not a JSON parser: the text may be cut off or
    nested, and the first occurrence counts. Possessive repeats keep the matcher from
    recursing once per character, so values may have any length.
    """
    pattern = f'(?s)"{field}"[^:]*:[^"]*"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)'
    return F.regexp_extract(as_column(text), pattern, 1)


def token_claims(authorization) -> Column:
    """Text of the middle part of a bearer token. The signature is not checked."""
    header = as_column(authorization)
    is_bearer = (F.lower(F.substring(header, 1, 7)) == "bearer ") & (F.length(header) >= 8)
    middle = F.translate(F.get(F.split(F.trim(F.substr(header, F.lit(8))), "\\."), F.lit(1)), "-_", "+/")
    padded = F.concat(middle, F.substr(F.lit("==="), F.lit(1), (4 - F.length(middle) % 4) % 4))
    return F.when(is_bearer, F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def sign_in_body(uri, body) -> Column:
    """The body if the request is a login or a registration."""
    uri = as_column(uri)
    is_sign_in = F.lit(False)
    for path in SIGN_IN_PATHS:
        is_sign_in = is_sign_in | uri.contains(path)
    return F.when(is_sign_in, as_column(body))


def first_filled(*candidates) -> Column:
    """The first that is neither null nor blank. Pass plain columns, not costly expressions."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def session_id(header, server_session) -> Column:
    return F.coalesce(blank_to_null(header), as_column(server_session), F.lit(""))


def client_id(header) -> Column:
    return F.coalesce(blank_to_null(header), F.lit(""))


def request_id(header, event_id) -> Column:
    """The header, or an id made from the event id.

    Made and not drawn, so that a task that runs twice writes the same id twice.
    """
    digest = F.md5(F.concat(F.lit("request:"), as_column(event_id)))
    parts = [F.substr(digest, F.lit(start), F.lit(length)) for start, length in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]]
    return F.coalesce(blank_to_null(header), F.concat_ws("-", *parts))


def user_id(principal, named: list[Column], session) -> Column:
    """The signed-in user, else the first of ``named``, else the session as a visitor."""
    principal = as_column(principal)
    signed_in = blank_to_null(F.when(principal != "anonymousUser", principal))
    visitor = F.concat(F.lit("anon:"), blank_to_null(session))
    return F.coalesce(signed_in, first_filled(*named), visitor, F.lit(ANONYMOUS))


def payload(body, content_type, query_string) -> Column:
    """A JSON body cut to 16 KiB, else the query string as JSON, else ''."""
    raw = F.encode(as_column(body), "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, PAYLOAD_BYTES).cast("string"))
    query = blank_to_null(query_string)
    escaped = F.replace(F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    has_json = F.lower(as_column(content_type)).contains("json") & (F.length(as_column(body)) > 0)
    return F.when(has_json, cut).otherwise(F.coalesce(F.concat(F.lit('{"query":"'), escaped, F.lit('"}')), F.lit("")))
