"""Commands, their text form, and responses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

U32_MAX = (1 << 32) - 1
#: Op codes by name.
OP_CODES = {
    "READ": 1, "WRITE": 2, "DELETE": 3, "COMPACT": 4, "STATS": 5, "LIST": 6, "EXISTS": 7, "PING": 8, "MGET": 9, "MSET": 10, "RANGE": 11, "TTL": 12, "INCR": 13, "PREFIX": 14,
    "COUNT_PREFIX": 15, "COUNT_RANGE": 16, "SUM_PREFIX": 17, "SUM_RANGE": 18, "AVG_PREFIX": 19, "AVG_RANGE": 20, "MIN_PREFIX": 21, "MIN_RANGE": 22, "MAX_PREFIX": 23, "MAX_RANGE": 24,
    "USE": 25, "CREATE_COLLECTION": 26, "DROP_COLLECTION": 27, "SHOW_COLLECTIONS": 28,
}
STATUSES = {"OK": 0, "NOT_FOUND": 1, "ERROR": 2, "NOOP": 3}


@dataclass(frozen=True)
class Command:
    """``op`` of OP_CODES (or INVALID with its code); keys: key, prefix, bounds or names; items: (key, value, ttl)."""

    op: str
    keys: tuple[str, ...] = ()
    items: tuple[tuple[str, str, int | None], ...] = ()
    ttl_secs: int | None = None
    code: int = 0


@dataclass(frozen=True)
class Response:
    status: str
    payload: tuple[str, ...] = field(default=())


class Quit(Exception):
    """The text asked to end the session."""


class BadCommand(ValueError):
    """A text that is no command; the message says how it should look."""


#: verb -> (words after it, usage); None for the counts of words that the code checks.
_KEYED = {"READ": "READ <key>", "DELETE": "DELETE <key>", "EXISTS": "EXISTS <key>", "INCR": "INCR <key>", "USE": "USE <collection>", "PREFIX": "PREFIX <prefix>"}
_BARE = ("COMPACT", "STATS", "LIST", "PING")
_REDUCED = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def _seconds(text: str, problem: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) > U32_MAX:
        raise BadCommand(problem)
    return int(text)


def parse_command(line: str) -> Command:
    """A command from its text: verbs in any case, words parted by blanks (a value's blanks become single)."""
    words = line.split()
    if not words:
        raise BadCommand("")
    verb, rest = words[0].upper(), words[1:]

    def need(ok: bool, usage: str) -> None:
        if not ok:
            raise BadCommand(f"Usage: {usage}")

    if verb == "QUIT":
        raise Quit
    if verb in _BARE:
        return Command(verb)
    if verb in _KEYED:
        need(len(rest) == 1, _KEYED[verb])
        return Command(verb, (rest[0],))
    if verb in _REDUCED:
        need(len(rest) in (1, 2), f"{verb} <prefix> | {verb} <start> <end>")
        return Command(f"{verb}_{'PREFIX' if len(rest) == 1 else 'RANGE'}", tuple(rest))
    if verb == "RANGE":
        need(len(rest) == 2, "RANGE <start> <end>")
        return Command(verb, tuple(rest))
    if verb == "WRITE":
        need(len(rest) >= 2, "WRITE <key> <value>")
        return Command(verb, items=((rest[0], " ".join(rest[1:]), None),))
    if verb == "WRITETTL":
        need(len(rest) >= 3, "WRITETTL <key> <seconds> <value>")
        seconds = _seconds(rest[1], "Invalid expiry time")
        need(seconds > 0, "WRITETTL <key> <seconds> <value> (seconds must be >= 1)")
        return Command("WRITE", items=((rest[0], " ".join(rest[2:]), seconds),))
    if verb == "MGET":
        need(bool(rest), "MGET <key1> <key2> <keyn>")
        return Command(verb, tuple(rest))
    if verb == "MSET":
        need(len(rest) >= 2, "MSET <key1> <value1> <keyn> <valuen>")
        return Command(verb, items=tuple((k, v, None) for k, v in zip(rest[::2], rest[1::2])))
    if verb == "MWRITETTL":
        usage = "MWRITETTL <seconds> <key1> <value1> <keyn> <valuen>"
        need(len(rest) >= 3 and len(rest) % 2 == 1, usage)
        seconds = _seconds(rest[0], "Invalid expiry time")
        need(seconds > 0, f"{usage} (seconds must be >= 1)")
        return Command("MSET", items=tuple((k, v, seconds) for k, v in zip(rest[1::2], rest[2::2])))
    if verb == "TTL":
        need(len(rest) == 2, "TTL <key> <seconds>")
        return Command(verb, (rest[0],), ttl_secs=_seconds(rest[1], "Invalid expiry time"))
    of_collection = bool(rest) and rest[0].upper() == "COLLECTION"
    if verb == "CREATE":
        need(of_collection and len(rest) >= 2, "CREATE COLLECTION <name> [default_ttl_secs]")
        return Command("CREATE_COLLECTION", (rest[1],), ttl_secs=_seconds(rest[2], "Invalid default TTL") if len(rest) > 2 else None)
    if verb == "DROP":
        need(of_collection and len(rest) == 2, "DROP COLLECTION <name>")
        return Command("DROP_COLLECTION", (rest[1],))
    if verb == "SHOW":
        need(len(rest) == 1 and rest[0].upper() == "COLLECTIONS", "SHOW COLLECTIONS")
        return Command("SHOW_COLLECTIONS")
    raise BadCommand(f"Unknown command: {words[0]}")


def printed(response: Response) -> str:
    """What a terminal shows for a response."""
    if response.status == "ERROR":
        return "\n".join(f"Error > {p}" for p in response.payload)
    if response.status == "NOT_FOUND":
        return "Not found"
    if response.status == "NOOP":
        return "NOOP"
    return "\n".join(response.payload) if response.payload else "OK"
