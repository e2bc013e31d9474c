"""python -m spandrel.cli diff A.json B.json: the report on one line.

Ends with 0 if the documents are equal, 1 if they differ, 2 on an error, and 3
if they nest too deep.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from spandrel.errors import MaxDepthError
from spandrel.operators.deep_diff import DEFAULT_MAX_DEPTH, MAX_DEPTH_CEILING, diff_json
from spandrel.sources.json_docs import read_document

DEPTH_VARIABLE = "SPANDREL_MAX_DEPTH"


def default_depth(value: str | None) -> int:
    """The variable's number if it is one within bounds."""
    return int(value) if value and value.isdigit() and int(value) <= MAX_DEPTH_CEILING else DEFAULT_MAX_DEPTH


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spandrel", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    d.add_argument("--max-depth", type=int, default=None)
    d.add_argument("--ignore-order", action="store_true")
    d.add_argument("--timing", action="store_true")
    return p


def run(args: list[str], out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        o = parser().parse_args(args)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    depth = o.max_depth if o.max_depth is not None else default_depth(os.environ.get(DEPTH_VARIABLE))
    began = time.perf_counter()
    try:
        report = diff_json(read_document(o.a), read_document(o.b), o.ignore_order, depth)
    except MaxDepthError as e:
        print(f"error: {e}", file=err)
        return 3
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=err)
        return 2
    print(report, file=out)
    if o.timing:
        print(f"{(time.perf_counter() - began) * 1000:.3f} ms", file=err)
    return int(report != "{}")


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
