"""Source files as nodes and edges.

Files come from Spark's binaryFile reader; Python is parsed with the ast
module and other languages by line patterns, both in mapInArrow tasks, which
give one table of rows (kind, node columns, edge columns).
"""

from __future__ import annotations

import ast
import fnmatch
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import map_arrow

# Folders and files a scan leaves out, and its size limit.
IGNORED = "node_modules dist build target vendor __pycache__ venv env out coverage bin obj".split()
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Cargo.lock Gemfile.lock composer.lock go.sum".split()
SENSITIVE = "id_rsa id_rsa.pub id_ed25519 id_ed25519.pub id_ecdsa id_dsa .env .env.local .env.production .env.staging .env.test credentials.json service_account.json service-account.json".split()
BINARY = "png jpg jpeg gif ico pdf zip gz tar jar class so dll exe woff woff2 ttf mp3 mp4 pyc db sqlite".split()
MOST_BYTES = 2 * 1024 * 1024

#: (language, extensions, kind, pattern with the name as last group).
PATTERNS = (
    ("typescript", "js jsx ts tsx mjs cjs", "import", r"""^\s*import\s+(?!type\b)(?:[^'"]*?from\s+)?['"]([^'"]+)['"]"""),
    ("typescript", "js jsx ts tsx mjs cjs", "import", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("typescript", "js jsx ts tsx mjs cjs", "type_import", r"""^\s*import\s+type\s+[^'"]*from\s+['"]([^'"]+)['"]"""),
    ("typescript", "js jsx ts tsx mjs cjs", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("typescript", "js jsx ts tsx mjs cjs", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("typescript", "js jsx ts tsx mjs cjs", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ("shell", "sh bash", "import", r"^\s*(?:source|\.)\s+(\S+)"),
    ("shell", "sh bash", "function", r"^\s*(?:function\s+)?(\w[\w-]*)\s*\(\)\s*\{?"),
    ("go", "go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("go", "go", "class", r"^type\s+(\w+)\s+(?:struct|interface)"),
    ("go", "go", "import", r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$'),
    ("rust", "rs", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    ("rust", "rs", "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"),
    ("rust", "rs", "import", r"^\s*use\s+([\w:]+)"),
    ("java", "java kt", "class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|data\s+|open\s+|sealed\s+)*(?:class|interface|enum|object)\s+(\w+)"),
    ("java", "java kt", "import", r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    ("java", "java", "function", r"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\{"),
    ("kotlin", "kt", "function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(\w+)"),
    ("c", "c h cpp hpp cc", "import", r'^\s*#include\s+[<"]([^>"]+)'),
    ("c", "c h cpp hpp cc", "class", r"^\s*(?:typedef\s+)?(?:class|struct)\s+(\w+)\s*[:{]"),
    ("c", "c h cpp hpp cc", "function", r"^[\w*&:<> ]+?[ *&](\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{"),
    ("csharp", "cs", "class", r"^\s*(?:\w+\s+)*(?:class|interface|record|struct)\s+(\w+)"),
    ("csharp", "cs", "import", r"^\s*using\s+([\w.]+);"),
    ("sql", "sql", "table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)"),
    ("sql", "sql", "reference", r"(?i)\breferences\s+[\"`]?([\w.]+)"),
    ("docker", "dockerfile", "import", r"(?i)^\s*from\s+(\S+)"),
    ("prisma", "prisma", "table", r"^\s*model\s+(\w+)"),
    ("proto", "proto", "class", r"^\s*message\s+(\w+)"),
    ("proto", "proto", "function", r"^\s*rpc\s+(\w+)"),
    ("graphql", "graphql gql", "class", r"^\s*(?:type|input|interface|enum)\s+(\w+)"),
    ("csharp", "cs", "function", r"^\s*(?:public|private|protected|internal)\s+(?:(?:static|async|override|virtual|sealed|abstract)\s+)*[\w<>\[\],.? ]+\s+(\w+)\s*\([^;]*\)\s*\{?\s*$"),
    ("docker", "dockerfile", "command", r"(?i)^\s*(?:cmd|entrypoint)\s+(.+?)\s*$"),
)
#: (extensions, edge type, pattern with a type and what it comes from).
SUPERTYPES = (
    ("js jsx ts tsx mjs cjs", "inherits", r"\bclass\s+(\w+)(?:<[^>]*>)?\s+extends\s+([\w.]+)"),
    ("ts tsx java kt cs", "implements", r"\bclass\s+(\w+)[^{]*?\bimplements\s+([\w.]+(?:<[^>]*>)?(?:\s*,\s*[\w.]+(?:<[^>]*>)?)*)"),
    ("java", "inherits", r"\bclass\s+(\w+)(?:<[^>]*>)?\s+extends\s+([\w.]+)"),
    ("rs", "implements", r"^\s*impl(?:<[^>]*>)?\s+(?P<of>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<type>\w+)"),
)
_SUPER = [(set(e.split()), k, re.compile(p)) for e, k, p in SUPERTYPES]
_COMPILED = [(set(e.split()), k, re.compile(p)) for _, e, k, p in PATTERNS]
ROW = "row_kind string, id string, name string, node_type string, path string, start_line int, end_line int, docstring string, source_id string, target_id string, edge_type string"


def ignore_pattern(line: str) -> str | None:
    """A line of an ignore file as a regular expression over relative paths: it
    matches the whole path, the file's name or any folder above; None for
    comments and blank lines.  Lines that take back others are not followed."""
    line = line.strip().strip("/")
    if not line or line[0] in "#!":
        return None
    body = fnmatch.translate(line).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")
    return f"(?s)(^|^.*/)(?:{body})($|/.*$)"


def scan(spark: SparkSession, root: str, ignored: tuple[str, ...] | None = None) -> DataFrame:
    """path (relative), content of the files worth parsing below a folder.

    ignored: lines of an ignore file; by default those of the folder's own
    .gitignore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").replace("file://", "")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^.*?{re.escape(base)}/", "")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(IGNORED))
    keep = ~hidden & ~name.isin(LOCKFILES + SENSITIVE) & ~F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(BINARY) & F.col("length").between(1, MOST_BYTES)
    for line in ignore_lines(spark, root) if ignored is None else ignored:
        if (pattern := ignore_pattern(line)) is not None:
            keep = keep & ~F.col("path").rlike(pattern)
    return files.withColumn("path", rel).filter(keep).select("path", "content")


def ignore_lines(spark: SparkSession, root: str) -> tuple[str, ...]:
    """The lines of a folder's .gitignore, which is small; none without one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return ()
    # Spark's readers pass over hidden files
    stream = fs.open(place)
    try:
        return tuple(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines())
    finally:
        stream.close()


def changed_paths(diffs: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted) of the files of unified diffs (id, diff)."""
    pairs = F.regexp_extract_all("diff", F.lit(r"(?m)^--- (?:a/)?(\S+).*\n\+\+\+ (?:b/)?\S+"), F.lit(1))
    after = F.regexp_extract_all("diff", F.lit(r"(?m)^--- (?:a/)?\S+.*\n\+\+\+ (?:b/)?(\S+)"), F.lit(1))
    x = diffs.select(F.explode(F.arrays_zip(pairs.alias("was"), after.alias("now"))).alias("f")).select("f.was", "f.now")
    none = "/dev/null"
    change = F.when(F.col("was") == none, "added").when(F.col("now") == none, "deleted").otherwise("modified")
    return x.select(F.when(F.col("now") == none, F.col("was")).otherwise(F.col("now")).alias("path"), change.alias("change")).distinct()


def _node(kind, i, name, path, start=None, end=None, doc=None):
    return ("node", i, name, kind, path, start, end, doc, None, None, None)


def _edge(a, b, kind):
    return ("edge", None, None, None, None, None, None, None, a, b, kind)


def parse_python(path: str, text: str) -> list[tuple]:
    """File, imports, classes, functions; contains, imports (type_depends_on
    under TYPE_CHECKING), inherits to type:*, calls to func_call:* or, for
    self.x(), to the method."""
    file = f"file:{path}"
    out = [_node("file", file, path.rpartition("/")[2], path)]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out

    def walk(body, owner, cls, typing_only):
        for n in body:
            if isinstance(n, ast.If) and "TYPE_CHECKING" in ast.unparse(n.test):
                walk(n.body, owner, cls, True)
                walk(n.orelse, owner, cls, typing_only)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                base = "." * n.level + (n.module or "") if isinstance(n, ast.ImportFrom) else None
                for a in n.names:
                    name = a.name if base is None else f"{base}.{a.name}"
                    i = f"import:{path}:{name}"
                    out.extend((_node("import", i, name, path, n.lineno, n.end_lineno), _edge(file, i, "type_depends_on" if typing_only else "imports")))
            elif isinstance(n, ast.ClassDef):
                i = f"class:{path}:{n.name}"
                out.extend((_node("class", i, n.name, path, n.lineno, n.end_lineno, ast.get_docstring(n)), _edge(owner, i, "contains")))
                out.extend(_edge(i, f"type:{ast.unparse(b)}", "inherits") for b in n.bases)
                walk(n.body, i, n.name, typing_only)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                i = f"func:{path}:{cls + '.' if cls else ''}{n.name}"
                out.extend((_node("function", i, n.name, path, n.lineno, n.end_lineno, ast.get_docstring(n)), _edge(owner, i, "contains")))
                for c in ast.walk(n):
                    if isinstance(c, ast.Call):
                        f = c.func
                        if isinstance(f, ast.Name):
                            out.append(_edge(i, f"func_call:{f.id}", "calls"))
                        elif isinstance(f, ast.Attribute):
                            own = cls and isinstance(f.value, ast.Name) and f.value.id == "self"
                            out.append(_edge(i, f"func:{path}:{cls}.{f.attr}" if own else f"func_call:{f.attr}", "calls"))

    try:
        walk(tree.body, file, None, False)
    except RecursionError:
        # too deep to follow: what was found before stays
        pass
    return out


def parse_lines(path: str, text: str) -> list[tuple]:
    """File, imports and symbols of other languages by line patterns."""
    file, name = f"file:{path}", path.rpartition("/")[2]
    ext = "dockerfile" if name.lower().startswith("dockerfile") else name.rpartition(".")[2].lower()
    out, seen = [_node("file", file, name, path)], set()
    mine = [(k, p) for e, k, p in _COMPILED if ext in e]
    above = [(k, p) for e, k, p in _SUPER if ext in e]
    block = model = None
    for no, line in enumerate(text.split("\n"), 1):
        for kind, p in above:
            for m in p.finditer(line):
                who, of = (m["type"], m["of"]) if "of" in p.groupindex else (m[1], m[2])
                out.extend(_edge(f"class:{path}:{who}", f"type:{x.split('<')[0].strip()}", kind) for x in of.split(","))
        if ext == "go":
            # an import block names a package a line
            block = True if re.match(r"import\s*\($", line.rstrip()) else None if line.startswith(")") else block
            if not block and not line.lstrip().startswith("import") and re.match(r'\s*(?:\w+\s+)?"[\w./-]+"\s*$', line):
                continue
        if ext == "prisma":
            model = m[1] if (m := re.match(r"\s*model\s+(\w+)", line)) else None if line.startswith("}") else model
            if model and (m := re.match(r"\s*\w+\s+(\w+)(?:\[\])?\??.*@relation\b", line)):
                out.append(_edge(f"table:{model}", f"table:{m[1]}", "references"))
        for kind, p in mine:
            for m in p.finditer(line):
                found = m[m.lastindex]
                if kind in ("import", "type_import"):
                    i = f"import:{path}:{found}"
                    rows = (_node("import", i, found, path, no, no), _edge(file, i, "imports" if kind == "import" else "type_depends_on"))
                elif kind == "command":
                    rows = (_edge(file, f"command:{found}", "calls"),)
                    i = f"command:{found}"
                elif kind == "reference":
                    rows = (_edge(file, f"table:{found}", "references"),)
                    i = f"reference:{found}:{no}"
                else:
                    i = f"table:{found}" if kind == "table" else f"{'class' if kind == 'class' else 'func'}:{path}:{found}"
                    rows = (_node(kind, i, found, path, no, no), _edge(file, i, "contains"))
                if i not in seen:
                    seen.add(i)
                    out.extend(rows)
    return out


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                text = (content or b"").decode("utf-8", "replace")
                rows += parse_python(path, text) if path.endswith(".py") else parse_lines(path, text)
            names = [x.split()[0] for x in ROW.split(", ")]
            kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows = map_arrow(files.select("path", "content"), run, ROW)
    nodes = rows.filter("row_kind = 'node'").select("id", "name", "node_type", "path", "start_line", "end_line", "docstring").dropDuplicates(["id"])
    return nodes, rows.filter("row_kind = 'edge'").select("source_id", "target_id", "edge_type", F.lit("extracted").alias("provenance"))


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """path, start, end of the changed ranges in unified diffs (id, diff)."""
    lines = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("no", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    file = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))
    hunk = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    h = lines.withColumn("path", F.last(file, ignorenulls=True).over(w)).filter(F.col("line").rlike(hunk))
    start = F.regexp_extract("line", hunk, 1).cast("int")
    size = F.coalesce(F.nullif(F.regexp_extract("line", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    return h.select("path", start.alias("start"), (start + F.greatest(size, F.lit(1)) - 1).alias("end"))
