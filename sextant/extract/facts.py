"""A collector of one file's facts, and what the lexers share."""

from __future__ import annotations

import re
from collections.abc import Callable

MAX_DEPTH = 500


class Facts:
    """Rows of one content, in the order they are found; repeated full names are numbered."""

    def __init__(self) -> None:
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.refs: list[dict] = []
        self.imports: list[dict] = []
        self.branches: list[dict] = []
        self.guard: str | None = None
        self.syntax_error = False
        self.too_deep = False
        self._seen: dict[str, int] = {}

    def symbol(self, name: str, qualified: str, kind: str, start: int, end: int, doc: str | None = None, **more) -> str:
        n = self._seen[qualified] = self._seen.get(qualified, 0) + 1
        full = qualified if n == 1 else f"{qualified}#{n}"
        row = {"internal": False, "typed": None, "consumed": False, "value": None, "declared": False} | more
        self.symbols.append({"ord": len(self.symbols), "name": name, "qualified": full, "kind": kind, "start": start, "end": end, "doc": doc or None, **row})
        return full

    def call(self, name: str, kind: str, line: int, caller: str | None, path: str | None = None, receiver: str | None = None, local: str | None = None, typed: str | None = None) -> None:
        self.calls.append({"ord": len(self.calls), "name": name, "path": path, "kind": kind, "line": line, "caller": caller, "receiver": receiver, "local": local, "typed": typed})

    def ref(self, name: str, kind: str, line: int, user: str | None, path: str | None = None, local: str | None = None, typed: str | None = None) -> None:
        self.refs.append({"ord": len(self.refs), "name": name, "path": path, "kind": kind, "line": line, "user": user, "local": local, "typed": typed})

    def import_(self, path: str, line: int, alias: str | None = None, glob: bool = False, public: bool = False, importer: str | None = None, via: str | None = None, condition: str | None = None) -> None:
        self.imports.append({"ord": len(self.imports), "path": path, "alias": alias, "glob": glob, "public": public, "line": line, "importer": importer, "via": via, "condition": condition})

    def branch(self, start: int, end: int, condition: str) -> None:
        self.branches.append({"ord": len(self.branches), "start": start, "end": end, "condition": condition})

    def done(self) -> dict:
        keys = ("symbols", "calls", "refs", "imports", "branches", "guard", "syntax_error", "too_deep")
        return {k: getattr(self, k) for k in keys}


def line_of(text: str) -> Callable[[int], int]:
    """Line number, from 1, of an offset."""
    import bisect

    ends = [m.end() for m in re.finditer("\n", text)]
    return lambda at: bisect.bisect_right(ends, at) + 1


def blanked(text: str, pattern: re.Pattern) -> str:
    """`text` with what the pattern matches made spaces, line ends kept: offsets and lines stay."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int, pairs: str = "{}") -> int:
    """Offset after the bracket that closes the one at `at`; the text's end if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pairs)}]").finditer(text, at):
        depth += 1 if m[0] == pairs[0] else -1
        if not depth:
            return m.end()
    return len(text)


def comment_above(lines: list[str], line: int, mark: re.Pattern, skip: re.Pattern | None = None) -> str | None:
    """The run of comment lines right above `line` (from 1), their marks taken off."""
    out: list[str] = []
    k = line - 2
    while k >= 0 and ((m := mark.match(lines[k])) or (skip and skip.match(lines[k]))):
        if m:
            out.append(m[1].strip())
        k -= 1
    return "\n".join(reversed(out)).strip() or None
