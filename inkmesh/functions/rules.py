"""V1 to V11 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas

#: Forms of ids, tokens, paths, local origins, and what redaction hides.
VAULT_ID = rf"^[A-Za-z0-9\-_]{{1,{schemas.MAX_VAULT}}}\z"
USER_ID = rf"^[A-Za-z0-9\-_.@]{{1,{schemas.MAX_USER}}}\z"
TOKEN = r"^[A-Za-z0-9\-_.]+\z"
PATH = r"^[A-Za-z0-9\-_/.]+\z"
LOCAL = r"^https?://(localhost|127\.0\.0\.1)(:[0-9]+)?\z"
HIDE_PATH, HIDE_IP, HIDE_TOKEN = r"/[a-zA-Z0-9/\-_.]+", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", r"[a-zA-Z0-9\-_]{20,}"
UNKNOWN_ERROR = "An error occurred"


def vault_id(c: Column) -> Column:
    return F.when(c.rlike(VAULT_ID), c)


def user_id(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("anonymous")).when(c.rlike(USER_ID), c)


def given_token(header: Column, url_token: Column) -> Column:
    """The authorization header as it is, scheme included, else the token of the URL; an empty header counts as none."""
    return F.coalesce(F.nullif(header, F.lit("")), url_token)


def token_ok(given: Column, expected: Column) -> Column:
    well_formed = lambda c: (F.length(c) <= schemas.MAX_TOKEN) & c.rlike(TOKEN)
    return F.coalesce(well_formed(given) & well_formed(expected) & (given == expected), F.lit(False))


def size_ok(message: Column) -> Column:
    return F.coalesce(F.octet_length(message), F.lit(0)) <= schemas.MAX_MESSAGE


def resolved(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty segments: a stack of segments, folded."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    push = lambda stack, s: F.when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), push), "/"))


def safe_path(path: Column, base: str) -> Column:
    """The resolved path if it is the base or below it; a path that starts with ``/`` replaces the base."""
    full = resolved(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base + "/"), path)))
    inside = (full == base) | F.startswith(full, F.lit(base.rstrip("/") + "/"))
    return F.when((F.length(path) <= schemas.MAX_PATH) & path.rlike(PATH) & inside, full)


def origin_ok(origin: Column, allowed: list[str] | None = None) -> Column:
    ok = origin.isin(allowed) if allowed else origin.rlike(LOCAL)
    return F.coalesce((origin != "") & ok, F.lit(False))


def redacted(text: Column) -> Column:
    """Paths, then addresses, then long tokens hidden; cut to 200 characters, which is the feature; empty gives a fixed text."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HIDE_PATH, "[PATH]"), HIDE_IP, "[IP]"), HIDE_TOKEN, "[TOKEN]")
    return F.coalesce(F.nullif(F.substring(out, 1, 200), F.lit("")), F.lit(UNKNOWN_ERROR))


def endpoint(url: Column, scheme: str = "wss") -> Column:
    """Sockets stay; https becomes wss and http ws; other urls take ``scheme``, the page's."""
    bare = F.regexp_replace(url, "^//", "")
    return (
        F.when(url.rlike("^wss?://"), url)
        .when(F.startswith(url, F.lit("https://")), F.regexp_replace(url, "^https://", "wss://"))
        .when(F.startswith(url, F.lit("http://")), F.regexp_replace(url, "^http://", "ws://"))
        .when(url.isNotNull(), F.concat(F.lit(scheme + "://"), bare))
    )
