"""A client for a terminal: ``python -m strandline.shell <folder of the store> [--max-parts 8 ...]``."""

from __future__ import annotations

import sys
from typing import TextIO

from strandline.config import EngineConfig
from strandline.plans.command import BadCommand, Quit, parse_command, printed
from strandline.session import Session


def talk(session: Session, lines: TextIO, out: TextIO, errors: TextIO, prompt: str = "> ") -> None:
    """Commands from ``lines`` until QUIT or the end, answers to ``out``, and what is no command to ``errors``."""
    while True:
        out.write(prompt)
        out.flush()
        line = lines.readline()
        if not line:
            return
        try:
            print(printed(session.execute(parse_command(line))), file=out)
        except Quit:
            return
        except BadCommand as e:
            if str(e):
                print(e, file=errors)


def main(args: list[str]) -> int:
    if not args or args[0].startswith("-"):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from strandline.sources.store import VersionStore

    try:
        config = EngineConfig.from_args(args[1:])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    session = Session(VersionStore(spark, args[0], config.retain_ms, config.retries), config)
    try:
        talk(session, sys.stdin, sys.stdout, sys.stderr)
    finally:
        session.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
