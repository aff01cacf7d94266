"""python -m tabloom TOOL WORKBOOK [ARGUMENT ...]: one tool, JSON on standard output."""

from __future__ import annotations

import json
import os
import sys

from .plans.workbook import Workbook
from .session import session
from .sources.ooxml import WorkbookError

TOOLS = {"map": "open_workbook", "find": "find", "schema": "get_region_schema", "trace": "trace_precedents", "impact": "trace_dependents", "path": "trace_path", "diag": "get_diagnostics", "symbols": "list_symbols", "read": "read_range", "explain": "explain_formula", "profile": "profile_column"}


def mermaid(tree: dict) -> str:
    """A trace tree as a left-to-right flowchart."""
    lines, n = ["flowchart LR"], 0
    todo = [(tree, None)]
    while todo:
        node, parent = todo.pop(0)
        lines.append(f'  n{n}["{node["ref"]}"]')
        if parent is not None:
            lines.append(f"  n{parent} --> n{n}")
        todo += [(c, n) for c in node["children"]]
        n += 1
    return "\n".join(lines)


def argument(text: str):
    """Numbers, lists and true, false or null as JSON; any other text as it stands."""
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return text if isinstance(value, str) else value


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in (*TOOLS, "graph"):
        print(__doc__, "\nTools:", *TOOLS, "graph", file=sys.stderr)
        return 2
    try:
        book = Workbook(session(), args[1], os.environ.get("TABLOOM_ROOT"))
        if args[0] == "graph":
            print(mermaid(book.trace_dependents(args[2], *map(argument, args[3:]))["tree"]))
        else:
            print(json.dumps(getattr(book, TOOLS[args[0]])(*args[2:3], *map(argument, args[3:])), ensure_ascii=False, indent=2))
    except WorkbookError as x:
        print(json.dumps({"error": {"code": x.code, "message": str(x)}}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
