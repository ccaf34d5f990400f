"""Workspace manifests and path aliases as rows."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import map_arrow

# Names of the files that list packages or aliases.
TSCONFIGS = ("tsconfig.json", "jsconfig.json", "tsconfig.base.json")


def _json(text: str):
    """JSON with line comments and trailing commas; None if it is none."""
    lines = [x for x in text.splitlines() if not x.lstrip().startswith(("//", "/*"))]
    try:
        return json.loads(re.sub(r",\s*([\]}])", r"\1", "\n".join(lines)))
    except ValueError:
        return None


def _listed(text: str, key: str) -> list[str]:
    """Items of a list under a key of simple YAML."""
    m = re.search(rf"^{key}:[^\S\n]*\n((?:[^\S\n]*(?:-.*|#.*)?\n?)*)", text, re.M)
    return [x.strip().strip("'\"") for x in re.findall(r"^\s*-\s*(.+?)\s*$", m[1], re.M)] if m else []


def _cargo(text: str) -> tuple[str | None, list[str], list[str]]:
    """(package, members, dependencies) of a Cargo manifest."""
    table, name, members, needs = "", None, [], []
    for line in text.splitlines():
        if m := re.match(r"\s*\[([^\]]+)\]\s*$", line):
            table = m[1]
        elif table == "package" and (m := re.match(r'\s*name\s*=\s*"([^"]+)"', line)):
            name = m[1]
        elif table.endswith("dependencies") and (m := re.match(r"\s*([\w-]+)\s*=", line)):
            needs.append(m[1])
    if m := re.search(r"^\s*members\s*=\s*\[(.*?)\]", text, re.M | re.S):
        members = re.findall(r'"([^"]+)"', m[1])
    return name, members, needs


def manifest_rows(path: str, text: str) -> list[tuple[str, str | None, str | None, list[str]]]:
    """(kind, name, value, items) of one file.

    workspace: items are the folders' patterns; package: name, its folder, the
    names it depends on; exports: name and its public files; alias: prefix and
    the path it stands for.  Other files and broken ones have none.
    """
    folder, _, file = path.rpartition("/")
    if file == "pnpm-workspace.yaml":
        return [("workspace", None, folder, _listed(text, "packages"))]
    if file == "Cargo.toml":
        name, members, needs = _cargo(text)
        return ([("package", name, folder, needs)] if name else []) + ([("workspace", None, folder, members)] if members else [])
    if file not in ("package.json", "lerna.json", *TSCONFIGS):
        return []
    data, out = _json(text), []
    if not isinstance(data, dict):
        return []
    if file in TSCONFIGS:
        options = data.get("compilerOptions") or {}
        base = (options.get("baseUrl") or ".").strip("/")
        for prefix, targets in (options.get("paths") or {}).items():
            if isinstance(targets, list) and targets and (head := prefix.rstrip("*").rstrip("/")):
                to = targets[0].rstrip("*").rstrip("/")
                to = (to if base == "." else f"{base}/{to}".strip("/")).removeprefix("./")
                out.append(("alias", head, to or ".", []))
        return out
    listed = data.get("packages") if file == "lerna.json" else data.get("workspaces")
    listed = listed.get("packages") if isinstance(listed, dict) else listed
    if isinstance(listed, list):
        out.append(("workspace", None, folder, [str(x) for x in listed]))
    if file == "package.json" and isinstance(data.get("name"), str):
        needs = [k for key in ("dependencies", "devDependencies", "peerDependencies") for k in (data.get(key) or {})]
        out.append(("package", data["name"], folder, sorted(set(needs))))
        files = data.get("exports")
        files = [files] if isinstance(files, str) else [v for v in files.values() if isinstance(v, str)] if isinstance(files, dict) else []
        files += [data["main"]] if isinstance(data.get("main"), str) and not files else []
        if files:
            out.append(("exports", data["name"], folder, files))
    return out


def manifests(files: DataFrame) -> DataFrame:
    """kind, name, value, items of manifest files (path, text); see manifest_rows."""

    def run(batches):
        for batch in batches:
            rows = [r for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for r in manifest_rows(p or "", t or "")]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["kind", "name", "value", "items"])

    return map_arrow(files.select("path", "text"), run, "kind string, name string, value string, items array<string>")


def aliases(rows: DataFrame) -> DataFrame:
    """prefix, target of packages' names and of path aliases; of one prefix the
    alias counts before the package, then the smallest target."""
    found = rows.filter("kind IN ('alias', 'package') AND name IS NOT NULL")
    best = found.groupBy(F.col("name").alias("prefix")).agg(F.min(F.struct((F.col("kind") != "alias").alias("k"), "value")).alias("m"))
    return best.select("prefix", F.col("m.value").alias("target"))


def packages(rows: DataFrame) -> DataFrame:
    """name, path, scope, exports, depends of the packages of a workspace; a
    scope is what stands before the '/' of a name with '@'."""
    p = rows.filter("kind = 'package'").groupBy("name").agg(F.min(F.struct("value", "items")).alias("m"))
    e = rows.filter("kind = 'exports'").groupBy("name").agg(F.min("items").alias("exports"))
    scope = F.regexp_extract("name", "^@([^/]+)/", 1)
    return p.join(e, "name", "left").select("name", F.col("m.value").alias("path"), F.nullif(scope, F.lit("")).alias("scope"), F.coalesce("exports", F.array().cast("array<string>")).alias("exports"), F.col("m.items").alias("depends"))
