"""Explicit schemas and limits; nothing is inferred."""

CONN_LOG = "event_id long, ts timestamp_ntz, connection_id string, ip string, origin string, vault_id string, user_id string, token string, kind string, direction string, msg_bytes long"
QUEUE = "array<struct<id: bigint, seq: bigint, type: string, path: string, newPath: string, content: string, userId: string>>"

#: Requests allowed and window in milliseconds by class, and the record map that the class uses.
LIMITS = {
    "default": (10, 1_000, "connection"),
    "connection": (5, 60_000, "ip"),
    "message": (100, 60_000, "connection"),
    "auth": (3, 60_000, "connection"),
}
#: Open connections per IP, message size, sizes of ids, tokens and paths, close codes.
MAX_OPEN, MAX_MESSAGE, MAX_VAULT, MAX_USER, MAX_TOKEN, MAX_PATH = 50, 1 << 20, 128, 64, 256, 4096
POLICY, TOO_LARGE, INTERNAL = 1008, 1009, 1011
