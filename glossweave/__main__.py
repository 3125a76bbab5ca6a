"""Command line: python -m glossweave run|scan <project> --languages de fr"""

from __future__ import annotations

import argparse
import json
import sys

from . import options as opt
from .pipeline import EveryRequestFailed, run
from .session import build_session
from .sources.bundles import MalformedBundle, UnsupportedFormat

OK, FAILED, USAGE, REFUSED = 0, 1, 2, 3


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossweave")
    p.add_argument("verb", choices=["run", "scan"])
    p.add_argument("project")
    p.add_argument("--config", help="JSON file; flags override its single values, lists are joined")
    for name in opt.LISTS:
        p.add_argument(f"--{name}", nargs="*", default=[])
    for name in ("source-language", "stack", "fmt", "resource-dir", "base-name", "work-dir", "context"):
        p.add_argument(f"--{name}")
    for name in ("max-files", "batch-size", "concurrency"):
        p.add_argument(f"--{name}", type=int)
    for name in ("apply", "apply-setup", "retranslate", "include-diagnostics"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--json", action="store_true", help="one JSON summary line")
    return p


def main(argv: list[str] | None = None) -> int:
    flags = vars(parser().parse_args(argv))
    verb, config, as_json, no_cache = (flags.pop(n) for n in ("verb", "config", "json", "no_cache"))
    stored = {}
    if config:
        with open(config, encoding="utf-8") as f:
            stored = json.load(f)
    if verb == "scan":
        flags["scan_only"] = True
    if no_cache:
        flags["use_cache"] = False
    try:
        options = opt.merge_config(stored, flags).validate()
    except (ValueError, UnsupportedFormat) as e:
        print(e, file=sys.stderr)
        return USAGE
    spark = build_session()
    try:
        result = run(spark, options)
    except (EveryRequestFailed, MalformedBundle, ValueError) as e:
        print(e, file=sys.stderr)
        return FAILED
    summary = {"candidates": result.candidates.count(), "bundles": result.merged, "rewrite": result.rewritten, "asked": result.asked, "tokens": {"read": result.tokens[0], "written": result.tokens[1]}, "seconds": round(result.seconds, 1)}
    print(json.dumps(summary) if as_json else "\n".join(f"{k}: {v}" for k, v in summary.items()))
    return REFUSED if result.refused_rewrite else OK


if __name__ == "__main__":
    sys.exit(main())
