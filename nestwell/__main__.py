"""Command line: ``python -m nestwell [--json] info|stats|verify STORE`` or ``backup|salvage|compact SOURCE TARGET``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="nestwell")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "stats", "verify"):
        sub.add_parser(name).add_argument("store")
    for name in ("backup", "salvage", "compact"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("target")
        if name == "compact":
            c.add_argument("page_size", nargs="?", type=int)
    args = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from nestwell.session import local_session
    from nestwell.sources import maintenance as m
    from nestwell.sources.store import Options, Store

    try:
        root = args.store if "store" in args else args.source
        m.require_local(root)
        spark = SparkSession.getActiveSession() or local_session(shuffle_partitions=4)
        m.require(spark, root)
        store = Store(spark, root, Options(read_only=args.command in ("info", "stats", "verify")))
        code = 0
        if args.command == "info":
            out = {"ok": True, **m.info(store)}
        elif args.command == "stats":
            out = {"ok": True, **asdict(store.stats())}
        elif args.command == "verify":
            issues = [{"invariant": r.invariant, "path": r.path, "key": bytes(r.key).hex() if r.key is not None else None} for r in store.verify_report().limit(100).collect()]
            out, code = {"ok": not issues, "valid": not issues, "issues": issues}, int(bool(issues))
        elif args.command == "backup":
            m.backup_to(store, args.target)
            out = {"ok": True, "destination": args.target}
        elif args.command == "compact":
            m.compact_to(store, args.target, args.page_size)
            out = {"ok": True, "destination": args.target}
        else:
            out = {"ok": True, "destination": args.target, **asdict(m.salvage_to(store, args.target))}
    except Exception as e:
        print(json.dumps({"ok": False, "error": str(e)}) if args.json else f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out) if args.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
    return code


if __name__ == "__main__":
    sys.exit(main())
