"""The binary form of commands and responses.

A frame is a 4-byte big-endian length of the rest, then an op code (or a status), then fields: keys with
2-byte lengths, values with 4-byte ones.  A write's flag byte says whether 4 bytes of seconds follow.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from strandline.plans.command import OP_CODES, STATUSES, Command, Response

HAS_TTL = 1
MAX_FRAME = (1 << 20) + (5 << 20) + 1024
_NAMES = {v: k for k, v in OP_CODES.items()}
_STATUS_NAMES = {v: k for k, v in STATUSES.items()}


class FrameError(ValueError):
    """Bytes that are no frame."""


def _key(text: str) -> bytes:
    data = text.encode()
    if len(data) > 0xFFFF:
        raise FrameError("a key has at most 65535 bytes here")
    return struct.pack(">H", len(data)) + data


def _framed(head: int, body: bytes) -> bytes:
    return struct.pack(">IB", len(body) + 1, head) + body


def _item(key: str, value: str, ttl: int | None) -> bytes:
    data = value.encode()
    return struct.pack(">B", HAS_TTL if ttl is not None else 0) + _key(key) + struct.pack(">I", len(data)) + data + (b"" if ttl is None else struct.pack(">I", ttl))


def encode_command(command: Command) -> bytes:
    if command.op in ("WRITE", "MSET"):
        body = b"".join(_item(*i) for i in command.items)
    elif command.op == "CREATE_COLLECTION":
        body = struct.pack(">B", HAS_TTL if command.ttl_secs is not None else 0) + _key(command.keys[0]) + (b"" if command.ttl_secs is None else struct.pack(">I", command.ttl_secs))
    else:
        body = b"".join(map(_key, command.keys)) + (struct.pack(">I", command.ttl_secs) if command.op == "TTL" else b"")
    return _framed(OP_CODES[command.op], body)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FrameError("the frame ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(f">{kind}", self.take(struct.calcsize(f">{kind}")))[0]

    def text(self, kind: str) -> str:
        try:
            return self.take(self.number(kind)).decode()
        except UnicodeDecodeError as e:
            raise FrameError("text that isn't UTF-8") from e

    def more(self) -> bool:
        return self.at < len(self.data)

    def item(self) -> tuple[str, str, int | None]:
        flags = self.number("B")
        return self.text("H"), self.text("I"), self.number("I") if flags & HAS_TTL else None


def decode_command(frame: bytes) -> Command:
    """A command from one whole frame; an op code that isn't known gives the command INVALID."""
    whole = _Reader(frame)
    body = _Reader(whole.take(whole.number("I")))
    code = body.number("B")
    op = _NAMES.get(code)
    if op is None:
        return Command("INVALID", code=code)
    if op == "WRITE":
        return Command(op, items=(body.item(),))
    if op == "MSET":
        items = []
        while body.more():
            items.append(body.item())
        return Command(op, items=tuple(items))
    if op == "MGET":
        keys = []
        while body.more():
            keys.append(body.text("H"))
        return Command(op, tuple(keys))
    if op == "CREATE_COLLECTION":
        flags, name = body.number("B"), body.text("H")
        return Command(op, (name,), ttl_secs=body.number("I") if flags & HAS_TTL else None)
    if op == "TTL":
        return Command(op, (body.text("H"),), ttl_secs=body.number("I"))
    n = 2 if op.endswith("RANGE") else 0 if op in ("COMPACT", "STATS", "LIST", "PING", "SHOW_COLLECTIONS") else 1
    return Command(op, tuple(body.text("H") for _ in range(n)))


def encode_response(response: Response) -> bytes:
    body = b"".join(struct.pack(">I", len(p.encode())) + p.encode() for p in response.payload)
    return _framed(STATUSES[response.status], body)


def decode_response(frame: bytes) -> Response:
    whole = _Reader(frame)
    body = _Reader(whole.take(whole.number("I")))
    status = body.number("B")
    if status not in _STATUS_NAMES:
        raise FrameError(f"unknown status byte: {status}")
    payload = []
    while body.more():
        payload.append(body.text("I"))
    return Response(_STATUS_NAMES[status], tuple(payload))


class FrameParser:
    """Whole frames from bytes as they arrive; one that is longer than MAX_FRAME is refused."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while len(self.held) >= 4:
            size = 4 + struct.unpack(">I", self.held[:4])[0]
            if size - 4 > MAX_FRAME:
                raise FrameError("the frame is too long")
            if len(self.held) < size:
                return
            frame, self.held = self.held[:size], self.held[size:]
            yield frame
