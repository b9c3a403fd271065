"""What a worktree's Cargo manifests say: libraries by name, the features a build turns on, and the targets it leaves out.

Manifests are few and small, so they are read and joined on the driver. A package is told by its
folder from the worktree's root, empty for the root itself.
"""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions import conditions
from sextant.functions.text import col
from sextant.sources import git

# Where a target of each kind has its root, by its name.
ROOTS = {"bin": ("src/bin/{}.rs", "src/bin/{}/main.rs"), "test": ("tests/{}.rs", "tests/{}/main.rs"), "bench": ("benches/{}.rs", "benches/{}/main.rs"), "example": ("examples/{}.rs", "examples/{}/main.rs")}
TABLES = ("dependencies", "dev-dependencies", "build-dependencies")


def package_of(path: Column | str) -> Column:
    """The folder of a file's package: above its src, tests, examples or benches, else its own."""
    above = F.regexp_extract(col(path), r"^(?:(.*?)/)?(?:src|tests|examples|benches)/", 1)
    own = F.regexp_extract(col(path), r"^(?:(.*)/)?[^/]*$", 1)
    return F.when(col(path).rlike("(^|/)(src|tests|examples|benches)/"), above).otherwise(own)


def read(root: str, paths: list[str]) -> dict[str, dict]:
    """Manifests by their folders."""
    out = {}
    for path in sorted(paths):
        with open(os.path.join(root, path), "rb") as f:
            out[posixpath.dirname(path)] = git.manifest(f.read())
    return out


def libraries(manifests: dict[str, dict]) -> dict[str, str]:
    """Folders of packages by the names that paths give their libraries."""
    return {name: folder for folder, m in manifests.items() if "package" in m and (name := git.library_name(m))}


def _within(folder: str, path: str | None) -> str | None:
    if not isinstance(path, str):
        return None
    at = posixpath.normpath(posixpath.join(folder, path))
    return None if at.startswith("..") else "" if at == "." else at


def _workspace(folder: str, manifests: dict[str, dict]) -> str | None:
    """The nearest folder at or above that has a workspace."""
    while "workspace" not in manifests.get(folder, {}):
        if not folder:
            return None
        folder = posixpath.dirname(folder)
    return folder


def dependencies(folder: str, manifests: dict[str, dict], host: dict) -> dict[str, dict]:
    """A package's dependencies by name: optional, default, features, and the folder they lie in, if in this worktree."""
    manifest = manifests[folder]
    tables = [manifest.get(t, {}) for t in TABLES]
    for condition, more in manifest.get("target", {}).items():
        predicate = condition[4:-1] if condition.startswith("cfg(") else None
        if predicate is None or conditions.cfg(predicate, host) is not False:
            tables += [more.get(t, {}) for t in TABLES]
    out: dict[str, dict] = {}
    for name, said in ((n, v if isinstance(v, dict) else {}) for t in tables for n, v in t.items()):
        at, features, default, path = folder, list(said.get("features", [])), said.get("default-features", True), said.get("path")
        if said.get("workspace") and (top := _workspace(folder, manifests)) is not None:
            shared = manifests[top]["workspace"].get("dependencies", {}).get(name, {})
            shared = shared if isinstance(shared, dict) else {}
            at, path = top, shared.get("path")
            features, default = features + list(shared.get("features", [])), shared.get("default-features", True)
        out[name] = {"optional": bool(said.get("optional")), "default": default, "features": features, "folder": _within(at, path)}
    return out


def features(manifests: dict[str, dict], host: dict) -> dict[str, set[str]]:
    """The features on in each package when the whole worktree is built with the defaults.

    Rules are applied over and over until they turn nothing more on.
    """
    packages = {f: m for f, m in manifests.items() if "package" in m}
    deps = {f: dependencies(f, manifests, host) for f in packages}
    declared = {}
    for folder, manifest in packages.items():
        own = {k: list(v) for k, v in manifest.get("features", {}).items()}
        said = {v.removeprefix("dep:") for values in own.values() for v in values if v.startswith("dep:")}
        declared[folder] = {n: [f"dep:{n}"] for n, d in deps[folder].items() if d["optional"] and n not in said} | own
    asked = {(f, "default") for f in packages}
    active = {(f, n) for f in packages for n, d in deps[f].items() if not d["optional"]}

    def led(folder: str, name: str) -> str | None:
        to = deps[folder].get(name, {}).get("folder")
        return to if to in packages else None

    def follows(folder: str, value: str):
        """What a value asks for: features as (folder, value), dependencies as (folder, name, None)."""
        name, slash, feature = value.partition("/")
        if value.startswith("dep:"):
            yield (folder, value[4:], None)
        elif slash:
            weak = name.endswith("?")
            name = name.removesuffix("?")
            if not weak:
                yield (folder, name, None)
                yield (folder, name)
            if (not weak or (folder, name) in active) and (to := led(folder, name)) is not None:
                yield (to, feature)
        else:
            yield from ((folder, v) for v in declared[folder].get(value, []))

    size = -1
    while size != len(asked) + len(active):
        size = len(asked) + len(active)
        for folder, name in list(active):
            if (to := led(folder, name)) is not None:
                asked |= {(to, v) for v in (["default"] if deps[folder][name]["default"] else []) + deps[folder][name]["features"]}
        for folder, value in list(asked):
            for got in follows(folder, value):
                if len(got) == 2:
                    asked.add(got)
                elif got[1] in deps[folder]:
                    active.add(got[:2])
    return {f: {v for at, v in asked if at == f and v in declared[f]} for f in packages}


def skipped(manifests: dict[str, dict], on: dict[str, set[str]], paths: set[str]) -> list[str]:
    """Roots of targets that need a feature of their package that is off; a dependency's feature counts as on."""
    out = []
    for folder, have in on.items():
        for kind, roots in ROOTS.items():
            for target in manifests[folder].get(kind, []):
                if all("/" in f or f in have for f in target.get("required-features", [])):
                    continue
                tried = [target["path"]] if "path" in target else [r.format(target.get("name", "")) for r in roots]
                out += [p for t in tried if (p := _within(folder, t)) in paths][:1]
    return sorted(set(out))
