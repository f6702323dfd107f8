"""Step functions of the sequential operators; batch folds and stream processors call the same ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Throttle:
    """Requests of one key in a window that its first request anchors, with violations that decay a window at a time. A record
    past its window by more than ``after_reset`` is forgotten, if that is given."""

    count: int = 0
    reset: int | None = None
    violations: int = 0

    def step(self, now: int, most: int, window: int, after_reset: int | None = None) -> tuple[bool, int | None, int | None]:
        """Allowed, remaining, and the advised wait."""
        self.forget(now, after_reset)
        if self.reset is None:
            self.reset = now + window
        elif now >= self.reset:
            self.count, self.reset, self.violations = 0, now + window, max(0, self.violations - 1)
        if self.count < most:
            self.count += 1
            return True, most - self.count, None
        self.violations += 1
        return False, None, window * 2 ** min(self.violations, 5)

    def forget(self, now: int, after_reset: int | None) -> bool:
        """Whether nothing is remembered at that time."""
        if after_reset is not None and self.reset is not None and now - self.reset > after_reset:
            self.count, self.reset, self.violations = 0, None, 0
        return self.reset is None


@dataclass
class Simple:
    """The older throttle: a window ends strictly after its length; nothing is remembered."""

    count: int = 0
    start: int | None = None

    def step(self, now: int, most: int, window: int) -> bool:
        if self.start is None or now - self.start > window:
            self.count, self.start = 1, now
            return True
        if self.count >= most:
            return False
        self.count += 1
        return True


@dataclass
class Gate:
    """Everything that admission remembers of one IP: open sessions with their last activity and message budget, and its rates.
    Sessions that are idle for more than ``idle`` end and free their slot; rates are forgotten ``after_reset``."""

    limits: dict[str, tuple[int, int]]
    most_open: int
    needs_token: bool = True
    idle: int | None = None
    after_reset: int | None = None
    sessions: dict[str, list] = field(default_factory=dict)
    open: int = 0
    rates: dict[str, Throttle] = field(default_factory=dict)

    def _may(self, rate: str, now: int) -> bool:
        return self.rates.setdefault(rate, Throttle()).step(now, *self.limits[rate], self.after_reset)[0]

    def connect(self, now: int, connection: str, origin_ok: bool, token_ok: bool, vault_ok: bool, user_ok: bool) -> str | None:
        """The first failing check, or None for admission. Budgets are spent in the order of the checks."""
        self.expire(now)
        if self.open >= self.most_open:
            return "ip_limit"
        if not self._may("connection", now):
            return "connection_rate"
        if not origin_ok:
            return "origin"
        if self.needs_token:
            if not self._may("auth", now):
                return "auth_rate"
            if not token_ok:
                return "token"
        if not vault_ok:
            return "vault_id"
        if not user_ok:
            return "user_id"
        self.sessions[connection] = [now, Throttle()]
        self.open += 1
        return None

    def message(self, now: int, connection: str, size_ok: bool | None) -> str | None:
        """None if the message passes. One that cannot be read (``size_ok`` is None) or is too large ends the session; one over the
        budget ends nothing."""
        self.expire(now)
        session = self.sessions.get(connection)
        if session is None:
            return "no_session"
        if not size_ok:
            self.close(connection)
            return "internal" if size_ok is None else "too_large"
        if not session[1].step(now, *self.limits["message"])[0]:
            return "message_rate"
        session[0] = now
        return None

    def close(self, connection: str, now: int | None = None) -> bool:
        """Whether a session ended; a second close of one changes nothing."""
        if now is not None:
            self.expire(now)
        if self.sessions.pop(connection, None) is None:
            return False
        self.open = max(0, self.open - 1)
        return True

    def expire(self, now: int) -> bool:
        """Ends what the time ends; whether nothing is remembered then."""
        if self.idle is not None:
            for c in [c for c, (last, _) in self.sessions.items() if now - last > self.idle]:
                self.close(c)
        self.rates = {k: r for k, r in self.rates.items() if not r.forget(now, self.after_reset)}
        return not (self.sessions or self.open or self.rates)

    def next_end(self) -> float:
        """The earliest time at which ``expire`` may end something."""
        times = [last + self.idle for last, _ in self.sessions.values()] if self.idle is not None else []
        return min(times + ([r.reset + self.after_reset for r in self.rates.values()] if self.after_reset is not None else []), default=math.inf)


@dataclass
class Replica:
    """Files, folders and identities of one client's queue, until an operation fails. ``moved`` has what the last step did to files:
    pairs of old and new path, without the one that a creation or a deletion lacks."""

    files: dict[str, str | None] = field(default_factory=dict)
    folders: set[str] = field(default_factory=set)
    origin: dict[str, tuple[str, int]] = field(default_factory=dict)
    blocked: bool = False
    moved: list[tuple[str | None, str | None]] = field(default_factory=list)

    def step(self, kind: str, path: str, new_path: str | None, content: str | None) -> str:
        """``applied``, ``skipped`` (succeeds without effect), ``failed`` or ``left``."""
        self.moved = []
        if self.blocked:
            return "left"
        if kind in ("rename", "move"):
            if not new_path:
                self.blocked = True
                return "failed"
            if path not in self.files:
                return "skipped"
            if (new_path in self.files or new_path in self.folders) and new_path != path:
                self.blocked = True
                return "failed"
            self.files[new_path] = self.files.pop(path)
            first, hops = self.origin.pop(path)
            self.origin[new_path] = (first, hops + 1)
            self.moved = [(path, new_path)]
            return "applied"
        taken = path in self.files or path in self.folders
        if kind == "create" and not taken:
            self.files[path], self.origin[path] = content or "", (path, 0)
            self.moved = [(None, path)]
            return "applied"
        if kind == "createFolder" and not taken:
            self.folders.add(path)
            return "applied"
        if kind in ("delete", "deleteFolder") and path in self.files:
            self._drop([path])
            return "applied"
        if kind == "deleteFolder" and path in self.folders:
            self._drop([f for f in self.files if f.startswith(path + "/")])
            self.folders = {f for f in self.folders if f != path and not f.startswith(path + "/")}
            return "applied"
        return "skipped"

    def _drop(self, paths: list[str]) -> None:
        for f in paths:
            del self.files[f], self.origin[f]
        self.moved = [(f, None) for f in paths]


@dataclass
class Session:
    """One connection's session; it ends by a close, or by more than a day without activity, also if no event comes any more."""

    created: int | None = None
    last: int = 0
    as_of: int = 0

    def step(self, now: int, kind: str, idle: int) -> tuple[int, int, int, str] | None:
        """The session that has ended when this event comes: created, last activity, end, and how."""
        ended = self.lapse(now, idle)
        if kind == "disconnect":
            if self.created is not None:
                ended, self.created = (self.created, self.last, now, "closed"), None
        else:
            self.created = now if self.created is None else self.created
            self.last = now
        return ended

    def lapse(self, now: int, idle: int) -> tuple[int, int, int, str] | None:
        """The session that the time ``now`` ends."""
        if self.created is None or now - self.last <= idle:
            return None
        ended, self.created = (self.created, self.last, self.last + idle, "expired"), None
        return ended


@dataclass
class Outbox:
    """Operations of one client: direct while it is connected, else held by vault until it is back. Then they go in order up to the
    first that fails; it and all later ones of that vault stay. An operation that comes again within ``remember`` counts once."""

    remember: int = 3600_000
    online: bool = False
    held: dict[str, list[tuple]] = field(default_factory=dict)
    stopped: set[str] = field(default_factory=set)
    seen: dict[int, int] = field(default_factory=dict)

    def status(self, now: int, status: str) -> Iterator[tuple]:
        """Rows of the queues that a return to ``connected`` drains: vault, id, time, route, outcome, time of the outcome."""
        was, self.online = self.online, status == "connected" if status in ("connected", "disconnected", "connecting") else self.online
        if not self.online or was:
            return
        for vault, queue in self.held.items():
            for key, at, fails in queue:
                outcome = "left" if vault in self.stopped else "failed" if fails else "applied"
                if fails:
                    self.stopped.add(vault)
                yield vault, key, at, "queued", outcome, now
        self.held = {}

    def operation(self, now: int, vault: str, key: int, kind: str, new_path: str | None) -> tuple | None:
        """The row of an operation that goes direct."""
        self.forget(now)
        if key in self.seen:
            return None
        self.seen[key] = now
        if self.online:
            return vault, key, now, "direct", "applied", now
        self.held.setdefault(vault, []).append((key, now, kind in ("rename", "move") and not new_path))
        return None

    def forget(self, now: int) -> bool:
        """Whether nothing is remembered at that time; ``seen`` is in the order of time."""
        for key, at in [*self.seen.items()]:
            if now - at <= self.remember:
                break
            del self.seen[key]
        return not (self.online or self.held or self.stopped or self.seen)


@dataclass
class Presence:
    """A client's last sign; without another within ``ttl`` it is gone."""

    ttl: int | None = None
    last: int | None = None

    def lapse(self, now: int) -> int | None:
        """The time at which it was gone, if it is by now."""
        if self.ttl is None or self.last is None or now - self.last <= self.ttl:
            return None
        gone, self.last = self.last + self.ttl, None
        return gone
