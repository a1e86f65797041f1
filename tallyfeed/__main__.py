"""Command line: append, replay, snapshot, asof, reconcile. Exit 0, 1 (usage, mismatch, other) or 2 (broken chain)."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from .functions.canon import decode
    from .sources.feed import Appender, ChainError

    parser = argparse.ArgumentParser(prog="tallyfeed")
    commands = parser.add_subparsers(dest="command", required=True)
    flags = {"append": ["type", "id", "effective", "payload"], "replay": [], "snapshot": ["out"], "asof": [], "reconcile": ["statement"]}
    for name, own in flags.items():
        p = commands.add_parser(name)
        p.add_argument("--feed", required=True)
        if name in ("snapshot", "asof", "reconcile"):
            p.add_argument("--seq", type=int, default=-1)
        for flag in own:
            p.add_argument(f"--{flag}", required=True)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        if args.command == "append":
            if missing := [f"--{n}" for n in ("effective", "id", "type") if not getattr(args, n)]:
                raise ValueError(f"missing required flag(s): {', '.join(missing)}")
            payload = decode(args.payload)
            if not isinstance(payload, dict):
                raise ValueError("payload must be a JSON object")
            done = Appender(args.feed).append(args.type, args.id, args.effective, payload)
            print(f"seq={done['seq']} hash={done['line_hash']}")
            return 0
        from pyspark.sql import SparkSession

        from .plans.snapshot import as_of, write_snapshot
        from .reader import FeedReader, load_statement, reconcile_document

        spark = SparkSession.builder.appName("tallyfeed").getOrCreate()
        if args.command == "replay":
            head = FeedReader(spark, args.feed).head()
            print(f"ok records={head.records} prefix_hash={head.prefix_hash}")
            return 0
        _, _, doc, data, digest = as_of(spark, args.feed, args.seq)
        if args.command == "asof":
            sys.stdout.buffer.write(data)
        elif args.command == "snapshot":
            print(digest, write_snapshot(args.out, data, digest))
        else:
            with open(args.statement, "rb") as f:
                found = reconcile_document(spark, doc, load_statement(f.read()))
            for instrument, field, ledger, custodian, delta in found.mismatches:
                print(f"instrument={instrument} field={field} ledger={ledger} custodian={custodian} delta={delta}")
            print(f"mismatches={len(found.mismatches)} compared={found.compared}")
            return int(bool(found.mismatches))
        return 0
    except ChainError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # every other failure is exit 1
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
