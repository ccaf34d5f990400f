"""What code declares to frameworks and message brokers: routes, injection,
tables, topics.

Python is read from its syntax tree, JavaScript and TypeScript from their
strings, words and brackets.
Both are driven by tables of rules, one row for each way of saying something.
"""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import map_arrow

# Methods of HTTP that name a route's decorator.
VERBS = "get post put delete patch options head".split()
SCRIPTS = ("js", "jsx", "ts", "tsx", "mjs", "cjs")
ROW = "row_kind string, id string, name string, node_type string, path string, start_line int, source_id string, target_id string, edge_type string, detail string"


class Rule(NamedTuple):
    """A call that names topics: its names, broker and direction; the keywords
    and the argument's place that hold the topic; whose method it must be, by
    a pattern; what the topic is without a name."""

    calls: frozenset[str]
    broker: str
    kind: str
    keywords: tuple[str, ...]
    place: int | None = 0
    owner: str = ""
    unnamed: str = ""


def _rule(calls: str, broker: str, kind: str, keywords: str, **more) -> Rule:
    return Rule(frozenset(calls.split()), broker, kind, tuple(keywords.split()), **more)


#: The first rule of a call's name that finds a topic counts.
CALLS = (
    _rule("send produce send_and_wait", "kafka", "publishes", "topic"),
    _rule("KafkaConsumer AIOKafkaConsumer", "kafka", "subscribes", "topics topic"),
    _rule("basic_publish", "rabbitmq", "publishes", "routing_key", place=1),
    _rule("basic_consume", "rabbitmq", "subscribes", "queue"),
    _rule("publish", "redis", "publishes", "channel name", owner=r"^(r|redis|client|redis_client)$|pubsub"),
    _rule("subscribe psubscribe", "redis", "subscribes", "channel channels"),
    _rule("send_message send_message_batch", "sqs", "publishes", "QueueUrl queue_url", place=None, unnamed="(?i)sqs|queue"),
    _rule("receive_message receive_messages", "sqs", "subscribes", "QueueUrl queue_url", place=None, unnamed="(?i)sqs|queue"),
)

#: Calls of scripts in the same terms: keywords are those of an object that is
#: the first argument.
SCRIPT_CALLS = (
    _rule("send", "kafka", "publishes", "topic", place=None),
    _rule("subscribe", "kafka", "subscribes", "topic topics", place=None),
    _rule("sendToQueue", "rabbitmq", "publishes", ""),
    _rule("publish", "rabbitmq", "publishes", "", place=1, owner="^channel$"),
    _rule("consume", "rabbitmq", "subscribes", ""),
    _rule("publish", "redis", "publishes", "", owner="^(redis|pub|client)"),
    _rule("subscribe psubscribe", "redis", "subscribes", "", owner="^(redis|sub|client)"),
    _rule("Worker", "bullmq", "subscribes", "", owner="^new$"),
    _rule("Queue", "bullmq", "publishes", "", owner="^new$"),
    _rule("SendMessageCommand SendMessageBatchCommand", "sqs", "publishes", "QueueUrl", place=None),
    _rule("ReceiveMessageCommand", "sqs", "subscribes", "QueueUrl", place=None),
)
PRIMITIVES = frozenset("string number boolean any unknown object".split())
MODIFIERS = frozenset("public private protected static async readonly override export default abstract".split())

#: Pieces of a script: comments, which count as nothing, strings, words, signs.
_PIECE = re.compile(r"//[^\n]*|/\*.*?\*/|(?P<text>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`)|(?P<word>[\w$]+)|(?P<sign>[^\s\w$])", re.S)
_OPEN, _CLOSE = "([{", ")]}"


def _slashed(path: str) -> str:
    return path if path.startswith("/") else "/" + path


class _Found:
    """Rows of one file; a topic, endpoint or table shows up once."""

    def __init__(self, path: str):
        self.path, self.rows, self.seen = path, [], set()

    def node(self, i: str, name: str, kind: str, line: int | None, detail: str) -> str:
        if i not in self.seen:
            self.seen.add(i)
            self.rows.append(("node", i, name, kind, self.path, line, None, None, None, detail))
        return i

    def edge(self, a: str, b: str, kind: str, detail: str) -> None:
        self.rows.append(("edge", None, None, None, self.path, None, a, b, kind, detail))

    def topic(self, name: str, broker: str, kind: str, who: str, line: int) -> None:
        self.edge(who, self.node(f"topic:{name}", name, "topic", line, broker), kind, broker)

    def endpoint(self, method: str, path: str, framework: str, line: int | None, handler: str | None) -> None:
        i = self.node(f"endpoint:{method}:{path}", f"{method} {path}", "endpoint", line, framework)
        if handler:
            self.edge(i, handler, "routes_to", framework)


def _last(f: ast.expr) -> str:
    """The name that a call or decorator ends with."""
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def _owner(f: ast.expr) -> str:
    return "" if not isinstance(f, ast.Attribute) else f.value.id if isinstance(f.value, ast.Name) else ast.unparse(f.value)


def _strings(value: ast.expr | None) -> list[str]:
    """Constants of an expression, or of the items of a list or tuple."""
    if isinstance(value, ast.Constant) and value.value is not None:
        return [str(value.value)]
    return [s for v in value.elts for s in _strings(v)] if isinstance(value, (ast.List, ast.Tuple)) else []


def _keyword(call: ast.Call, *names: str) -> ast.expr | None:
    return next((k.value for k in call.keywords if k.arg in names), None)


def _provider(value: ast.expr | None) -> str:
    """What Depends(...) is given, here or among the notes of Annotated[...]."""
    if isinstance(value, ast.Call) and _last(value.func) == "Depends" and value.args:
        return _last(value.args[0])
    if isinstance(value, ast.Subscript) and _last(value.value) == "Annotated":
        notes = value.slice.elts if isinstance(value.slice, ast.Tuple) else [value.slice]
        return next((p for p in map(_provider, notes) if p), "")
    return ""


def _task(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The name a task is queued by, '' if the function is none."""
    for d in f.decorator_list:
        call = d if isinstance(d, ast.Call) else None
        if _last(call.func if call else d) in ("task", "shared_task"):
            named = _strings(_keyword(call, "name")) if call else []
            return named[0] if named else f"celery:{f.name}"
    return ""


def _route(d: ast.expr) -> tuple[str, str, str] | None:
    """(method, path, framework) of a decorator that makes a route."""
    if not isinstance(d, ast.Call) or not isinstance(d.func, ast.Attribute):
        return None
    name = d.func.attr.lower()
    if name not in (*VERBS, "route", "api_route"):
        return None
    methods = _strings(_keyword(d, "methods")) if name in ("route", "api_route") else [name]
    path = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str) else "/"
    return (methods or ["GET"])[0].upper(), _slashed(path), "flask" if _owner(d.func).lower() in ("bp", "blueprint") else "fastapi"


def python_semantics(path: str, text: str) -> list[tuple]:
    """Routes, injections, mapped tables, topics of a Python file; none if it
    does not parse, and what comes before where it nests too deep to follow."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found, file = _Found(path), f"file:{path}"
    tasks = {n.name: t for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) if (t := _task(n))}

    def call(n: ast.Call, who: str) -> None:
        name, owner = _last(n.func), _owner(n.func)
        if name in ("delay", "apply_async") and owner:
            queue = _strings(_keyword(n, "queue", "routing_key")) if name == "apply_async" else []
            found.topic(queue[0] if queue else tasks.get(owner, f"celery:{owner}"), "celery", "publishes", who, n.lineno)
            return
        for r in CALLS:
            if name not in r.calls or r.owner and not re.search(r.owner, owner):
                continue
            given = [s for k in r.keywords for s in _strings(_keyword(n, k))]
            if not given and r.place is not None and len(n.args) > r.place:
                given = _strings(n.args[r.place])
            if r.broker == "sqs":
                given = [g.rstrip("/").rpartition("/")[2] for g in given] or ([owner] if owner and re.search(r.unnamed, owner) else [])
            heard = _last(_keyword(n, "on_message_callback")) if name == "basic_consume" and _keyword(n, "on_message_callback") else ""
            for topic in given if r.kind == "subscribes" else given[:1]:
                found.topic(topic, r.broker, r.kind, f"func:{path}:{heard}" if heard else who, n.lineno)
            if given:
                return

    def walk(n: ast.AST, who: str, cls: str) -> None:
        if isinstance(n, ast.ClassDef):
            names = [s for a in n.body if isinstance(a, ast.Assign) and any(_last(t) == "__tablename__" for t in a.targets) for s in _strings(a.value)]
            django = any(_last(b) == "Model" for b in n.bases)
            if names or django:
                table, orm = (names or [n.name.lower()])[-1], "django" if django else "sqlalchemy"
                found.edge(f"class:{path}:{n.name}", found.node(f"table:{table}", table, "table", n.lineno, orm), "maps_to", orm)
            who, cls = f"class:{path}:{n.name}", n.name
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            who = f"func:{path}:{cls + '.' if cls else ''}{n.name}"
            if n.name in tasks and _task(n):
                found.topic(tasks[n.name], "celery", "subscribes", who, n.lineno)
            for d in n.decorator_list:
                if r := _route(d):
                    found.endpoint(*r, n.lineno, who)
            a = n.args
            positional = [*a.posonlyargs, *a.args]
            given = [None] * (len(positional) - len(a.defaults)) + list(a.defaults)
            for p, value in [*zip(positional, given), *zip(a.kwonlyargs, a.kw_defaults)]:
                if provider := _provider(value) or _provider(p.annotation):
                    found.edge(who, f"symbol:{provider}", "injects", p.arg)
        elif isinstance(n, ast.Call):
            call(n, who)
        for child in ast.iter_child_nodes(n):
            walk(child, who, cls)

    try:
        walk(tree, file, "")
    except RecursionError:
        pass
    return found.rows


class _Piece(NamedTuple):
    kind: str
    value: str
    line: int


def _pieces(text: str) -> list[_Piece]:
    """Strings without their quotes, words and signs, with their lines."""
    out, line, at = [], 1, 0
    for m in _PIECE.finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        if m.lastgroup:
            out.append(_Piece(m.lastgroup, m[0][1:-1] if m.lastgroup == "text" else m[0], line))
    return out


def _partners(pieces: list[_Piece]) -> dict[int, int]:
    """Where each bracket closes; one that never does closes at the end."""
    found, open_ = {}, []
    for i, p in enumerate(pieces):
        if p.kind == "sign" and p.value in _OPEN:
            open_.append(i)
        elif p.kind == "sign" and p.value in _CLOSE and open_:
            found[open_.pop()] = i
    return found | {i: len(pieces) for i in open_}


def _split(pieces: list[_Piece], partner: dict[int, int], first: int, end: int) -> list[tuple[int, int]]:
    """The stretches between the commas from first to end, brackets skipped."""
    out, start, i = [], first, first
    while i < end:
        if pieces[i] == ("sign", ",", pieces[i].line):
            out.append((start, i))
            start = i + 1
        i = partner.get(i, i) + 1
    return [*out, (start, end)] if end > first else []


def script_semantics(path: str, text: str) -> list[tuple]:
    """Express routes, controllers with their actions, injectables and what
    constructors inject, topics of a JavaScript or TypeScript file."""
    found, file, pieces = _Found(path), f"file:{path}", _pieces(text)
    partner, n = _partners(pieces), len(pieces)
    sign = lambda i, v: 0 <= i < n and pieces[i].kind == "sign" and pieces[i].value == v
    word = lambda i: pieces[i].value if 0 <= i < n and pieces[i].kind == "word" else ""
    only = lambda a, b: pieces[a].value if b == a + 1 and pieces[a].kind == "text" else None

    def texts(a: int, b: int) -> list[str]:
        """A string, or those of a list."""
        inner = _split(pieces, partner, a + 1, partner[a]) if sign(a, "[") and partner.get(a) == b - 1 else [(a, b)]
        return [t for x, y in inner if (t := only(x, y))]

    def fields(a: int, b: int) -> dict[str, list[str]]:
        """Of an object: the strings that its fields hold."""
        inner = _split(pieces, partner, a + 1, partner[a]) if sign(a, "{") and partner.get(a) == b - 1 else []
        return {pieces[x].value: texts(x + 2, y) for x, y in inner if sign(x + 1, ":")}

    def declared(i: int) -> int:
        """Behind further decorators and modifiers: what is decorated."""
        while i < n and (sign(i, "@") or word(i) in MODIFIERS):
            i = i + 1 if not sign(i, "@") else partner.get(i + 2, i + 1) + 1
        return i

    prefix = owner = None
    for i in range(n):
        name = word(i)
        if not name or not sign(i + 1, "("):
            continue
        given = _split(pieces, partner, i + 2, min(partner[i + 1], n))
        line, behind = pieces[i].line, partner[i + 1] + 1
        first = only(*given[0]) if given else None
        who = word(i - 2) if sign(i - 1, ".") else word(i - 1)
        if sign(i - 1, "@"):
            at = declared(behind)
            if name in ("Controller", "Injectable") and word(at) == "class" and (at := at + 1):
                if name == "Injectable":
                    found.node(f"class:{path}:{word(at)}", word(at), "class", line, "injectable")
                else:
                    prefix, owner = _slashed(first).rstrip("/") if first else "", word(at)
            elif owner and name.lower() in VERBS and name.istitle() and sign(at + 1, "("):
                found.endpoint(name.upper(), prefix + (_slashed(first) if first else "") or "/", "nestjs", line, f"func:{path}:{owner}.{word(at)}")
            continue
        if name in VERBS and who in ("app", "router") and first is not None:
            last = given[-1]
            handler = word(last[0]) if len(given) > 1 and last[1] == last[0] + 1 else ""
            found.endpoint(name.upper(), _slashed(first), "express", line, f"func:{path}:{handler}" if handler else None)
        if name == "constructor":
            for a, b in given:
                colon = next((k for k in range(a, b) if sign(k, ":")), b)
                kind = word(colon + 1)
                if kind and kind not in PRIMITIVES:
                    found.edge(file, f"symbol:{kind}", "injects", word(colon - 2 if sign(colon - 1, "?") else colon - 1))
        for r in SCRIPT_CALLS:
            if name in r.calls and (not r.owner or re.search(r.owner, who)):
                by_name = fields(*given[0]) if given else {}
                topics = [t for k in r.keywords for t in by_name.get(k, [])] or ([] if r.place is None or len(given) <= r.place else texts(*given[r.place]))
                for t in topics if r.kind == "subscribes" else topics[:1]:
                    found.topic(t.rstrip("/").rpartition("/")[2] if r.broker == "sqs" else t, r.broker, r.kind, file, line)
    return found.rows


def semantics(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that files (path, content) declare; other kinds of files
    and null contents have none.  A node that several files declare is the one
    of the first path; detail is its framework or broker."""

    def run(batches):
        names = [x.split()[0] for x in ROW.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in ROW.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                text, ext = (content or b"").decode("utf-8", "replace"), (path or "").rpartition(".")[2].lower()
                rows += python_semantics(path, text) if ext == "py" else script_semantics(path, text) if ext in SCRIPTS else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows = map_arrow(files.select("path", F.col("content").cast("binary").alias("content")), run, ROW)
    nodes = rows.filter("row_kind = 'node'").groupBy("id").agg(F.min(F.struct("path", "start_line", "name", "node_type", "detail")).alias("m"))
    nodes = nodes.select("id", "m.name", "m.node_type", "m.path", "m.start_line", "m.detail")
    return nodes, rows.filter("row_kind = 'edge'").select("source_id", "target_id", "edge_type", F.col("detail"), F.lit("extracted").alias("provenance"))
