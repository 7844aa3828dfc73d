"""What an engine can be told: its kind, and when and how collections are compacted."""

from __future__ import annotations

from dataclasses import dataclass, fields

ENGINES = ("lsm", "kv")


@dataclass(frozen=True)
class EngineConfig:
    """``engine``: "lsm" has everything; "kv" has no collections, scans or aggregates.

    After a write a collection is compacted once it has more than ``max_parts`` parts, or once more than ``max_dead_ratio`` of
    its versions are dead (0: never).  ``background``: COMPACT answers at once and works on beside.
    ``retain_ms``: how long what a compaction replaced stays for readers; ``retries``: of a write after a conflict.
    """

    engine: str = "lsm"
    max_parts: int = 0
    max_dead_ratio: float = 0.0
    background: bool = False
    retain_ms: int = 3_600_000
    retries: int = 16

    def __post_init__(self) -> None:
        if self.engine not in ENGINES:
            raise ValueError(f"no such engine: {self.engine}")
        if self.max_parts < 0 or not 0 <= self.max_dead_ratio <= 1 or self.retain_ms < 0 or self.retries < 0:
            raise ValueError("a limit is out of its range")

    @staticmethod
    def from_args(args: list[str]) -> EngineConfig:
        """``--max-parts 8 --engine kv --background``: the fields by name, with dashes."""
        kinds, found, at = {f.name: type(f.default) for f in fields(EngineConfig)}, {}, 0
        while at < len(args):
            name = args[at].removeprefix("--").replace("-", "_")
            if not args[at].startswith("--") or name not in kinds:
                raise ValueError(f"unknown argument: {args[at]}")
            if kinds[name] is bool:
                found[name], at = True, at + 1
                continue
            if at + 1 == len(args):
                raise ValueError(f"{args[at]} needs a value")
            try:
                found[name], at = kinds[name](args[at + 1]), at + 2
            except ValueError:
                raise ValueError(f"invalid value for {args[at]}: {args[at + 1]}") from None
        return EngineConfig(**found)
