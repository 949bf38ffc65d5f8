"""Command line: ``python -m spanveil extract|redact|policies``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from pathlib import Path


def read(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanveil", description="Find and remove personal identifiers in a text")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("extract", help="print what is found as JSON")
    two = commands.add_parser("redact", help="print the text under a policy")
    commands.add_parser("policies", help="list the built-in policies")
    for c in (one, two):
        c.add_argument("path", help="a file, or - for standard input")
        c.add_argument("--model", default="rules", help="detector; only rules come with the engine")
    # Keeping values as they are is no choice here.
    two.add_argument("--policy", default="ferpa", help="built-in name or file")
    two.add_argument("--method", choices=("mask", "replace", "hash", "shift_dates"), help="if not the policy's own")
    two.add_argument("--json", action="store_true", help="a record without the values found instead of the text")
    asked = parser.parse_args(args)
    from spanveil import api

    try:
        if asked.command == "policies":
            print("\n".join(api.available_policies()))
        elif asked.command == "extract":
            found = api.extract(read(asked.path), model_name=asked.model)
            print(json.dumps({"text": found.text, "detector": found.detector, "spans": [dataclasses.asdict(s) for s in found.spans]}, indent=2, ensure_ascii=False))
        else:
            out = api.deidentify(read(asked.path), asked.policy, asked.method, model_name=asked.model)
            print(json.dumps(out.record, indent=2, ensure_ascii=False) if asked.json else out.text)
    except (api.LeakFound, api.ModelUnavailable, FileNotFoundError) as e:
        print(f"spanveil: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
