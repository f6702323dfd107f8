"""All registered queries of the library but those of its ``llm`` part."""

from __future__ import annotations

from . import admission, content, oplog, reconcile, sessions, streams, validation
from .registry import Query


def catalogue() -> dict[str, Query]:
    return {**validation.QUERIES, **admission.QUERIES, **sessions.QUERIES, **reconcile.QUERIES, **oplog.QUERIES, **content.QUERIES, **streams.QUERIES}
