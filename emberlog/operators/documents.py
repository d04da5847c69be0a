"""Nested documents: redaction of JSON at any depth, attributes of events, and redaction of texts by position.

These work on whole values that a regular expression over JSON text would cut: Arrow functions parse each different value of
a batch once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import REDACTIONS

# ---- each different value once


def _by_value(column: pa.Array, of, kind: pa.DataType) -> pa.Array:
    """of(value) for each row of a column; equal values are worked on once."""
    coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    done = pa.array([of(x) for x in coded.dictionary.to_pylist()] + [of(None)], kind)
    return done.take(coded.indices.fill_null(len(done) - 1))


def _parsed(text: str | None):
    try:
        return json.loads(text, parse_int=str, parse_float=str, parse_constant=str) if text else None
    except (ValueError, RecursionError):
        return None


# ---- labels

_SANITIZE = [(re.compile(pattern, re.ASCII), re.sub(r"\$(\d)", r"\\g<\1>", to)) for pattern, to in REDACTIONS]


def _sanitized(value):
    if isinstance(value, str):
        for pattern, to in _SANITIZE:
            value = pattern.sub(to, value)
        return value.strip()
    if isinstance(value, dict):
        return {k: _sanitized(v) for k, v in value.items()}
    return [_sanitized(v) for v in value] if isinstance(value, list) else value


def _sanitized_json(text: str | None) -> str | None:
    if not text:
        return text
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return _sanitized(text)
    clean = _sanitized(value)
    return text if clean == value else json.dumps(clean, ensure_ascii=False, separators=(",", ":"))


def sanitized_json(column: Column) -> Column:
    """JSON with the redactions of messages in each of its texts, at any depth, in lists too; keys, numbers and their order
    stay. A text without secrets stays as it is; what is no JSON is redacted as a message."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return _by_value(texts, _sanitized_json, pa.string())

    return clean(column)


# ---- attributes (fixed values)

EXPLICIT_KEYS = ("event_type", "error_type", "exception_type", "exception_class", "failure_kind", "event_class")
CODE_KEYS = ("error_code", "errno", "sqlstate", "grpc_status", "response_code", "status_code", "http_status")
CLASS_KEYS = ("exception_class", "exception_type")
FAMILY_KEYS = ("event_family", "failure_domain", "category")
STATUS_KEYS = ("status", "status_code", "http_status", "response_status", "response_code")
TEXT_KEYS = ("action", "error", "error_type", "event_class", "event_type", "exception", "exception_type", "failure", "failure_reason", "outcome", "reason", "result", "sample_reason", "state", "status")
EMPTY = ("", "false", "n/a", "na", "none", "null", "true", "unknown")
DEPTH = 4


def scalars_of(value, depth: int = DEPTH, path: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(path, name, value as text) of the scalars of an object, in its order; deeper objects, lists and nulls are left out."""
    out = []
    for key, child in value.items() if isinstance(value, dict) else ():
        name = str(key).strip().lower().replace("-", "_")
        if isinstance(child, dict):
            out += scalars_of(child, depth - 1, (*path, name)) if depth else []
        elif isinstance(child, (str, bool)):
            out.append((".".join((*path, name)), name, child if isinstance(child, str) else str(child).lower()))
    return out


def name_of(value: str) -> str:
    return re.sub(r"[\W_]+", "_", unicodedata.normalize("NFKC", value).lower()).strip("_")[:120]


def semantic_name(column: Column) -> Column:
    """A name as name_of makes it, with compatible forms of characters made one (NFKC)."""

    @F.arrow_udf("string")
    def named(texts: pa.Array) -> pa.Array:
        return _by_value(texts, lambda x: name_of(x or ""), pa.string())

    return named(column)


def code_of(value: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.:-]+", "_", unicodedata.normalize("NFKC", value).strip()).strip("_")[:120]


def _first(rows, keys, of) -> str:
    return next((x for key in keys for _, name, value in rows if name == key and (x := of(value)).lower() not in EMPTY), "")


FACTS = "code string, thrown string, explicit string, family string, said string, server_error boolean, keys array<string>, first map<string,string>"
_FACTS = pa.struct([("code", pa.string()), ("thrown", pa.string()), ("explicit", pa.string()), ("family", pa.string()), ("said", pa.string()), ("server_error", pa.bool_()), ("keys", pa.list_(pa.string())), ("first", pa.map_(pa.string(), pa.string()))])


def _facts(text: str | None) -> dict:
    rows = scalars_of(_parsed(text))
    first: dict[str, str] = {}
    for _, name, value in rows:
        first.setdefault(name, value.strip())
    status = (re.search(r"\b\d{3}\b", value) for _, name, value in rows if name in STATUS_KEYS)
    return {
        "code": _first(rows, CODE_KEYS, code_of), "thrown": _first(rows, CLASS_KEYS, name_of), "explicit": _first(rows, EXPLICIT_KEYS, name_of), "family": _first(rows, FAMILY_KEYS, name_of),
        "said": " ".join(value for _, name, value in rows if name in TEXT_KEYS and value.strip().lower() not in EMPTY), "server_error": any(m and m[0][0] == "5" for m in status), "keys": list(first), "first": list(first.items()),
    }


def attribute_facts(column: Column) -> Column:
    """What the scalars of a JSON object say, as a struct (FACTS): the first code, class of exception, explicit name and
    family, each by the priority of its keys and then by place, the texts that describe what happened, whether a status is
    5xx, the names, and the first value of each. Escapes, repeated keys (the last counts) and keys at several depths are
    those of the object; what is no object says nothing."""

    @F.arrow_udf(FACTS)
    def facts(texts: pa.Array) -> pa.Array:
        return _by_value(texts, _facts, _FACTS)

    return facts(column)


def flattened(df: DataFrame, key: str, attributes: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, name, value) of the scalars of JSON objects down to a depth; lists are left out."""

    @F.arrow_udf("array<struct<path: string, name: string, value: string>>")
    def rows(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("name", pa.string()), ("value", pa.string())]))
        return _by_value(texts, lambda x: [dict(zip(("path", "name", "value"), r)) for r in scalars_of(_parsed(x), depth)], kind)

    return df.select(key, F.explode(rows(F.col(attributes))).alias("r")).select(key, "r.*")


# ---- redaction with hashes (fixed values): kinds that a match counts as, pattern, what it becomes

SECRET = "<REDACTED_SECRET>"
USER_HOME = r"(?i)(?:/home/[^/\s:]+|/Users/[^/\s:]+|[A-Z]:\\Users\\[^\\\s:]+)"
INTERNAL_URL = r"(?i)\bhttps?://(?:localhost|127\.0\.0\.1|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|metadata\.google\.internal|[^/\s'\"]+\.(?:internal|local|corp|lan))(?::\d+)?(?:/[^\s'\"]*)?"
AUTH_HEADER = r"(?i)\b(Authorization\s*[:=]\s*)(?:Bearer|Basic)?\s*[A-Za-z0-9._~+/=\-]{6,}"
COOKIE = r"(?i)\b(?:Cookie|Set-Cookie)\s*[:=]\s*[^,\s;]+(?:;\s*[^,\s;=]+=[^,\s;]+)*"
SECRET_VALUE = r"""(?i)\b(api[_-]?key|x[-_]?api[-_]?key|access[_-]?token|refresh[_-]?token|id[_-]?token|session(?:[_-]?id)?|password|passwd|secret|client[_-]?secret|private[_-]?key|google_application_credentials|credentials|credential|service_account|gmail[_-]?token|pubsub[_-]?token)\s*[:=]\s*('(?:[^']*)'|"(?:[^"]*)"|[^\s,;]+)"""
ID_VALUE = r"""(?i)\b(user[_-]?id|order[_-]?id|tracking[_-]?id|track[_-]?id|customer[_-]?id|account[_-]?id)\s*[:=]\s*('(?:[^']*)'|"(?:[^"]*)"|[A-Za-z0-9_.:\-]{3,})"""
CLOUD_KEY, OAUTH_TOKEN = r"\bAIza[0-9A-Za-z_\-]{20,}\b", r"\bya29\.[0-9A-Za-z_\-./]+\b"
JWT, SK_KEY = r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b", r"(?i)\bsk-(?:live|test|proj)?-?[A-Za-z0-9_\-]{12,}\b"
KEY_BLOCK = r"-----BEGIN PRIVATE KEY-----.*?-----END PRIVATE KEY-----"
BEARER, BASIC = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=\-]{8,}", r"(?i)\bBasic\s+[A-Za-z0-9+/=]{8,}"
EMAIL, IP = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"


def hash_of(value: str, name: str) -> str:
    return f"<{name}:{hashlib.sha256(value.encode()).hexdigest()[:12]}>"


def _secret_kinds(m: re.Match) -> list[str]:
    key = m[1].lower()
    more = (("token_like", ("token", "session")), ("gmail_credential", ("gmail",)), ("pubsub_credential", ("pubsub",)), ("cloud_credential", ("google", "credential", "service_account")))
    return ["secret_like", *[kind for kind, words in more if any(w in key for w in words)]]


def _unquoted(value: str) -> str:
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"" else value


#: In this order: what one rule has replaced is there for the next one to read.
RULES = tuple((re.compile(pattern), kinds if callable(kinds) else lambda _, k=kinds: list(k), to if callable(to) else lambda _, t=to: t) for pattern, kinds, to in (
    (USER_HOME, ("user_home",), "<USER_HOME>"), (INTERNAL_URL, ("internal_url",), lambda m: hash_of(m[0], "URL_HASH")),
    (AUTH_HEADER, lambda m: ["authorization_header", "token_like", *["basic_auth"] * ("basic" in m[0].lower())], SECRET), (COOKIE, ("cookie", "secret_like"), SECRET),
    (SECRET_VALUE, _secret_kinds, SECRET), (ID_VALUE, ("id_like",), lambda m: f"{m[1]}={hash_of(_unquoted(m[2]), 'ID_HASH')}"),
    (CLOUD_KEY, ("cloud_credential", "secret_like"), SECRET), (OAUTH_TOKEN, ("cloud_credential", "token_like"), SECRET), (JWT, ("token_like", "secret_like"), SECRET), (SK_KEY, ("secret_like",), SECRET),
    (KEY_BLOCK, ("secret_like",), SECRET), (BEARER, ("token_like",), SECRET), (BASIC, ("basic_auth", "token_like"), SECRET),
    (EMAIL, ("email",), lambda m: hash_of(m[0].lower(), "EMAIL_HASH")), (IP, ("ip_address",), lambda m: hash_of(m[0], "IP_HASH")),
))


def redacted_text(text: str | None) -> tuple[str, dict[str, int]]:
    """A text without secrets, and how often each kind was found. Matches are replaced where they stand, so that equal values
    get equal hashes and no match is changed within another."""
    counts: dict[str, int] = {}
    text = text or ""
    for pattern, kinds, to in RULES:

        def put(m, kinds=kinds, to=to):
            for kind in kinds(m):
                counts[kind] = counts.get(kind, 0) + 1
            return to(m)

        text = pattern.sub(put, text)
    return re.sub(r"\s+", " ", text).strip(), counts


def redacted(column: Column) -> Column:
    """struct (text, counts) of a column's redacted texts: see redacted_text."""

    @F.arrow_udf("text string, counts map<string,int>")
    def clean(texts: pa.Array) -> pa.Array:
        def of(x):
            text, counts = redacted_text(x)
            return {"text": text, "counts": sorted(counts.items())}

        return _by_value(texts, of, pa.struct([("text", pa.string()), ("counts", pa.map_(pa.string(), pa.int32()))]))

    return clean(column)


#: What must not be in a redacted text (fixed values).
VERIFY = (
    ("secret_like", r"(?i)\bAuthorization\s*:"), ("secret_like", r"(?i)\bBearer\s+"), ("secret_like", r"(?i)\bBasic\s+"), ("secret_like", r"(?i)\bCookie\s*:"), ("secret_like", r"(?i)\bSet-Cookie\s*:"),
    ("secret_like", r"(?i)\bpassword\s*="), ("secret_like", r"(?i)\bpasswd\s*="), ("secret_like", r"(?i)\bsecret\s*="), ("secret_like", r"(?i)\bprivate_key\b"), ("secret_like", r"(?i)\bapi_key\b"), ("secret_like", r"(?i)\baccess_token\b"),
    ("secret_like", r"(?i)\brefresh_token\b"), ("secret_like", r"(?i)\bsession_id\b"), ("secret_like", r"(?i)\bsk-[A-Za-z0-9_\-]{8,}"), ("secret_like", r"\bAIza[0-9A-Za-z_\-]{10,}"), ("secret_like", r"\bya29\.[0-9A-Za-z_\-./]+"),
    ("secret_like", r"-----BEGIN PRIVATE KEY-----"), ("internal_url", r"(?i)\bhttps?://(?:internal[^\s'\",}]*|[^/\s'\",}]*\.internal[^\s'\",}]*)"), ("internal_url", r"(?i)\b[A-Za-z0-9_.-]+\.internal\b"), ("user_home", USER_HOME), ("email", EMAIL), ("ip_address", IP),
)
