"""Facts of Markdown: sections with their anchors, links, and paths and code names in prose."""

from __future__ import annotations

import re
import unicodedata

from sextant.extract.facts import Facts

HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
LINK = re.compile(r"!?\[(?:[^\[\]]|\[[^\]]*\])*\]\(\s*(?:<([^>]*)>|([^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
DEFINITION = re.compile(r"^ {0,3}\[[^\]]+\]:\s*<?([^\s>]+)>?")
SPAN = re.compile(r"(`+)(.+?)\1(?!`)", re.S)
IDS = re.compile(r"<[A-Za-z][^>]*?\sid\s*=\s*[\"']([^\"']+)[\"']|<a\s[^>]*?name\s*=\s*[\"']([^\"']+)[\"']", re.I)
EXTENSIONS = r"(?:rs|nix|sh|bash|py|pyi|c|h|md|markdown|toml|json|txt|lock)"
PATH = re.compile(rf"(?<![\w/.:@-])((?:\.{{0,2}}/)?(?:[\w.-]+/)*[\w.-]+\.{EXTENSIONS})(?::(\d+))?(?![\w/])")
NAME = re.compile(r"^(?:[A-Za-z_]\w*(?:::|\.))*[A-Za-z_]\w*(?:\(\))?!?$")


def slug(heading: str) -> str:
    """GitHub's anchor of a heading."""
    keep = lambda c: c in " -" or c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Pc")
    return "".join("-" if c == " " else c for c in heading.lower() if keep(c))


def plain(heading: str) -> str:
    """A heading's text without its markup."""
    heading = LINK.sub(lambda m: re.sub(r"^!?\[|\]\($", "", m[0].split("](")[0]), heading)
    return re.sub(r"(?<!\\)[*`]|(?<!\w)_|_(?!\w)", "", heading).strip()


def relative(destination: str) -> str | None:
    """A destination that names a place of the worktree, without its query."""
    d = destination.strip()
    if d in ("", "#") or d.startswith("//") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", d):
        return None
    path, mark, fragment = d.partition("#")
    return path.split("?")[0] + mark + fragment


def extract(data: bytes) -> dict:
    facts, text = Facts(), data.decode("utf-8", "replace")
    lines = text.split("\n")
    last = max(1, len(lines) - (lines[-1] == ""))
    start = 0
    if lines[0].strip() == "---":  # front matter
        ends = [k for k, line in enumerate(lines[1:], 1) if line.strip() in ("---", "...")]
        start = ends[0] + 1 if ends else 0
    facts.symbol("", "", "file", 1, last)
    headings: list[tuple[int, int, str]] = []
    used: dict[str, int] = {}  # anchors, and how often each has been numbered
    anchors: list[tuple[str, int]] = []
    prose: list[tuple[int, str]] = []
    fence = None
    for k in range(start, len(lines)):
        line = lines[k]
        m = FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(m[1][0]):
                fence = None
            continue
        if m:
            fence = m[1]
            continue
        m = HEADING.match(line)
        if m:
            headings.append((k + 1, len(m[1]), plain(m[2] or "")))
        elif k > start and line.strip() and re.match(r"^ {0,3}(=+|-+)[ \t]*$", line) and lines[k - 1].strip() and not HEADING.match(lines[k - 1]):
            headings.append((k, 1 if "=" in line else 2, plain(lines[k - 1])))
        anchors += [(a or b, k + 1) for a, b in IDS.findall(line)]
        prose.append((k + 1, line))
    places = []
    for i, (at, level, name) in enumerate(headings):
        until = next((h[0] - 1 for h in headings[i + 1 :] if h[1] <= level), last)
        # A section ends with text.
        while until > at and not lines[until - 1].strip():
            until -= 1
        anchor = base = slug(name)
        while anchor in used:
            used[base] += 1
            anchor = f"{base}-{used[base]}"
        used[anchor] = 0
        places.append((at, until, facts.symbol(name, anchor, "section", at, until, value=anchor)))
    for name, at in anchors:
        facts.symbol(name, name, "anchor", at, at)
    for at, line in prose:
        user = next((full for a, b, full in reversed(places) if a <= at <= b), None)
        for m in [*LINK.finditer(line), *filter(None, [DEFINITION.match(line)])]:
            target = relative(next((g for g in m.groups() if g is not None), ""))
            if target:
                facts.import_(target, at, importer=user, via="link")
        rest = LINK.sub(" ", line)
        for m in SPAN.finditer(rest):
            code = m[2].strip()
            if NAME.match(code) and not re.fullmatch(PATH, code):
                path = code.removesuffix("!").removesuffix("()")
                facts.ref(re.split(r"::|\.", path)[-1], "mention", at, user, path=path)
        for m in PATH.finditer(rest):
            facts.ref(m[1].rsplit("/", 1)[-1], "path", at, user, path=m[1], local=m[2])
    return facts.done()
