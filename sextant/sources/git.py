"""Sources: a git worktree's files, history and blobs, manifests and a task board.

Git is asked by the driver, which lists; what the lists name is read and parsed by executors.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import schemas
from sextant.functions import text

HEAD_BYTES = 256


def git(root: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=stdin, capture_output=True, check=True).stdout


def toplevel(folder: str) -> str:
    """The root of the worktree that holds `folder`."""
    return git(folder, "rev-parse", "--show-toplevel").decode().rstrip("\n")


def listed(root: str) -> list[str]:
    """Tracked and untracked files that are not ignored, sorted; paths that are not UTF-8 are left out."""
    out = set()
    for raw in git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split(b"\0"):
        try:
            out.add(raw.decode())
        except UnicodeDecodeError:
            continue
    return sorted(out - {""})


def stat(root: str, path: str) -> tuple[int, int, int, int] | None:
    """size, mtime and ctime in nanoseconds and inode of a regular file."""
    try:
        got = os.lstat(os.path.join(root, path))
    except OSError:
        return None
    return (got.st_size, got.st_mtime_ns, got.st_ctime_ns, got.st_ino) if os.path.isfile(os.path.join(root, path)) and not os.path.islink(os.path.join(root, path)) else None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime, ctime, inode of each listed regular file."""
    rows = [(p, *s) for p in listed(root) if (s := stat(root, p))]
    return spark.createDataFrame(rows, "path string, size long, mtime long, ctime long, inode long")


def contents(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, data, blob and language of files: read by Spark's binary source, each file's language by name or head."""
    if not paths:
        return spark.createDataFrame([], "path string, data binary, blob string, language string")
    base = os.path.abspath(root)
    # Spark's file sources pass over empty files.
    bare = [(p, bytearray()) for p in paths if not os.path.getsize(os.path.join(base, p))]
    full = [os.path.join(base, p) for p in paths if os.path.getsize(os.path.join(base, p))]
    none = spark.createDataFrame([(os.path.join(base, p), d) for p, d in bare], "path string, content binary")
    files = spark.read.format("binaryFile").load(full).select("path", "content").unionByName(none) if full else none
    named = F.regexp_replace(F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), "^file:/+", "/")), "^" + re.escape(base) + "/", "")
    return files.select(named.alias("path"), F.col("content").alias("data"), text.blob_id(F.col("content")).alias("blob")).withColumn("language", text.language_of("path", F.decode(F.substring("data", 1, HEAD_BYTES), "ISO-8859-1")))


def order(root: str, head: str = "HEAD") -> list[str]:
    """Commits without merges, newest first, in topological order."""
    return git(root, "rev-list", "--no-merges", "--topo-order", head).decode().split()


def log(root: str, shas: list[str]) -> list[dict]:
    """sha, time, subject, body of commits."""
    if not shas:
        return []
    raw = git(root, "log", "--no-walk=unsorted", "--stdin", "-z", "--format=%H%x1f%ct%x1f%s%x1f%B", stdin="\n".join(shas).encode()).decode("utf-8", "replace")
    out = []
    for record in raw.split("\0"):
        if record.strip():
            sha, time, subject, body = record.split("\x1f", 3)
            out.append({"sha": sha.strip(), "time": int(time), "subject": subject, "body": body})
    return out


TRAILER = re.compile(r"^([A-Za-z0-9][A-Za-z0-9-]*): ?(.*)$")


def trailers(body: str) -> list[tuple[str, str]]:
    """`Key: value` lines of the paragraphs after the subject that hold nothing else, continuation lines joined."""
    out: list[tuple[str, str]] = []
    for paragraph in re.split(r"\n\s*\n", body.strip())[1:]:
        found: list[list[str]] = []
        for line in paragraph.splitlines():
            m = TRAILER.match(line)
            if m:
                found.append([m[1], m[2].strip()])
            elif line[:1].isspace() and found:
                found[-1][1] += " " + line.strip()
            else:
                found = []
                break
        out += [(k, v) for k, v in found]
    return out


HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def diff(root: str, sha: str) -> Iterator[dict]:
    """Changed files of a commit against its first parent: path, renamed, status, added, removed, old and new blob, hunks."""
    raw = git(root, "diff-tree", "-r", "-M", "-U0", "--root", "--no-commit-id", "--raw", "-p", "--full-index", "--no-color", sha).decode("utf-8", "replace")
    changes: dict[str, dict] = {}
    now: dict | None = None
    for line in raw.split("\n"):
        if line.startswith(":"):
            meta, *names = line[1:].split("\t")
            _, _, old, new, status = meta.split()
            path = names[-1]
            changes[path] = {
                "path": path, "renamed": names[0] if status.startswith("R") else None, "status": {"A": "added", "D": "deleted", "R": "renamed"}.get(status[0], "modified"),
                "added": 0, "removed": 0, "old": old, "new": new, "hunks": [],
            }
        elif line.startswith("diff --git "):
            now = None
        elif line.startswith(("--- a/", "+++ b/")):
            now = changes.get(line[6:].rstrip("\t"), now)
        elif now is not None and (m := HUNK.match(line)):
            a, b, c, d = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            now["hunks"].append((a, b, c, d))
            now["removed"] += b
            now["added"] += d
    yield from changes.values()


def blobs(root: str, ids: list[str]) -> dict[str, bytes]:
    """Bytes of blobs; those git lacks are left out."""
    out, raw, at = {}, git(root, "cat-file", "--batch", stdin="".join(f"{i}\n" for i in ids).encode()), 0
    for want in ids:
        end = raw.index(b"\n", at)
        head = raw[at:end].split()
        at = end + 1
        if len(head) == 3:
            out[want] = raw[at : at + int(head[2])]
            at += int(head[2]) + 1
    return out


def history(spark: SparkSession, root: str, known: set[str] = frozenset(), batch: int = 512) -> dict[str, DataFrame]:
    """commits, trailers, changes and hunks of the commits not yet known; `place` counts from the newest."""
    all_of = order(root)
    commits, lines, changes, hunks = [], [], [], []
    new = [(k, sha) for k, sha in enumerate(all_of) if sha not in known]
    for at in range(0, len(new), batch):
        part = new[at : at + batch]
        place = {sha: k for k, sha in part}
        for c in log(root, [sha for _, sha in part]):
            rev = c["sha"]
            commits.append((rev, rev, place[rev], c["time"], c["subject"]))
            lines += [(rev, k, v) for k, v in trailers(c["body"])]
            for f in diff(root, rev):
                changes.append((rev, f["path"], f["renamed"], f["status"], f["added"], f["removed"], f["old"], f["new"]))
                hunks += [(rev, f["path"], *h) for h in f["hunks"]]
    make = spark.createDataFrame
    return {
        "commits": make(commits, "rev string, sha string, place long, time long, subject string"),
        "trailers": make(lines, "rev string, key string, value string"),
        "changes": make(changes, "rev string, path string, renamed string, status string, added int, removed int, old string, new string"),
        "hunks": make(hunks, "rev string, path string, old_start int, old_count int, new_start int, new_count int"),
    }


def manifest(data: bytes) -> dict:
    """A Cargo manifest; an unreadable one is empty."""
    try:
        return tomllib.loads(data.decode("utf-8", "replace"))
    except tomllib.TOMLDecodeError:
        return {}


def library_name(cargo: dict) -> str | None:
    name = cargo.get("lib", {}).get("name") or cargo.get("package", {}).get("name")
    return name.replace("-", "_") if isinstance(name, str) else None


def tasks(spark: SparkSession, lines: list[str]) -> DataFrame:
    """A board's tasks from JSON lines: id, state, title, commits, notes. Ids that are not digits are left out."""
    rows = []
    for line in lines:
        try:
            t = json.loads(line)
        except ValueError:
            break  # one failure ends the reading
        if str(t.get("id", "")).isdigit():
            notes = [(n.get("id"), n.get("kind"), n.get("title"), n.get("superseded_by") or []) for n in t.get("notes", [])]
            rows.append((str(t["id"]), t.get("state"), t.get("title"), [str(c) for c in t.get("commits", [])], notes))
    return spark.createDataFrame(rows, schemas.TASKS)


def extracted(files: DataFrame, extract) -> DataFrame:
    """One row of facts a file: `extract` maps (language, bytes) to a dict of schemas.EXTRACTION."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([{"blob": b, "language": lang, **extract(lang, bytes(d))} for b, lang, d in zip(part.blob, part.language, part.data, strict=True)], columns=["blob", "language", *schemas.EXTRACTION.fieldNames()])

    return files.select("blob", "language", "data").mapInPandas(run, schemas.EXTRACTED)
