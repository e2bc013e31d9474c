"""Findings of a comparison, by category and path, and how paths are written."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from . import values as V

#: Categories in the order of the report. Fixed values of the format.
CATEGORIES = (
    "type_changes",
    "values_changed",
    "dictionary_item_added",
    "dictionary_item_removed",
    "iterable_item_added",
    "iterable_item_removed",
    "set_item_added",
    "set_item_removed",
    "attribute_added",
    "attribute_removed",
)

Path = tuple  # of ("index", i), ("key", k), ("attr", name), ("member", v)


def quoted(key: str) -> str:
    return f'"{key}"' if "'" in key else f"'{key}'"


def _member(value: Any) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    return str(value) if isinstance(value, dt.date | dt.time | dt.timedelta) else repr(value)


def _key(key: Any) -> str:
    if isinstance(key, str):
        return quoted(key)
    if isinstance(key, tuple):
        return "][".join(quoted(k) if isinstance(k, str) else repr(k) for k in key)
    return str(key) if isinstance(key, dt.date) else repr(key)


def render(path: Path) -> str:
    out = ["root"]
    for kind, x in path:
        if kind == "attr":
            out.append(f".{x}")
        else:
            out.append(f"[{x if kind == 'index' else _member(x) if kind == 'member' else _key(x)}]")
    return "".join(out)


class Findings:
    """Per category: path -> entry. Added and removed things are their values."""

    def __init__(self) -> None:
        self.by: dict[str, dict[Path, Any]] = {c: {} for c in CATEGORIES}

    def __len__(self) -> int:
        return sum(map(len, self.by.values()))

    def value_changed(self, path: Path, old: Any, new: Any, new_path: Path | None = None, diff: str | None = None) -> None:
        self.by["values_changed"][path] = {"old_value": old, "new_value": new} | ({"new_path": new_path} if new_path else {}) | ({"diff": diff} if diff else {})

    def type_changed(self, path: Path, old: Any, new: Any, new_path: Path | None = None) -> None:
        self.by["type_changes"][path] = {"old_type": V.type_name(old), "new_type": V.type_name(new), "old_value": old, "new_value": new} | ({"new_path": new_path} if new_path else {})

    def take(self, other: Findings) -> None:
        for c, found in other.by.items():
            self.by[c].update(found)

    def merge_mutual(self) -> None:
        """What was added and removed at one place has changed there."""
        added, removed = self.by["iterable_item_added"], self.by["iterable_item_removed"]
        places = {render(p): p for p in removed}
        for p in [p for p in added if render(p) in places]:
            at = places[render(p)]
            self.value_changed(at, removed.pop(at), added.pop(p))

    def moved(self, depth: int, index: int) -> None:
        """All changes are at another index, at this depth of the path, in the second document."""
        for c in ("values_changed", "type_changes"):
            for path, entry in self.by[c].items():
                at = list(entry.get("new_path") or path)
                at[depth] = ("index", index)
                entry["new_path"] = tuple(at)

    def rows(self) -> Iterator[tuple]:
        """(category, path, old_type, new_type, old_value, new_value, new_path, diff); values as JSON text."""
        for c in CATEGORIES:
            for path, x in sorted(self.by[c].items(), key=lambda i: render(i[0])):
                if c in ("type_changes", "values_changed"):
                    yield (c, render(path), x.get("old_type"), x.get("new_type"), V.write_json(x["old_value"]), V.write_json(x["new_value"]), render(x["new_path"]) if "new_path" in x else None, x.get("diff"))
                elif c.endswith("removed"):
                    yield (c, render(path), None, None, V.write_json(x), None, None, None)
                else:
                    yield (c, render(path), None, None, None, V.write_json(x), None, None)

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for c in CATEGORIES:
            found = self.by[c]
            if not found:
                continue
            if c.startswith("set_item"):
                out[c] = sorted({render(p) for p in found})
            elif c in ("type_changes", "values_changed"):
                out[c] = {render(p): {k: render(v) if k == "new_path" else v for k, v in x.items()} for p, x in sorted(found.items(), key=lambda i: render(i[0]))}
            else:
                out[c] = {render(p): v for p, v in sorted(found.items(), key=lambda i: render(i[0]))}
        return out
