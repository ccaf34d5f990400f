"""Framework and event extraction, manifests, stores, change streams."""

import json
import time

from graphloom import sinks, stores
from graphloom.sources import capabilities, docs, packages, semantics
from graphloom.streaming import changes
from pyspark.sql import functions as F

PYTHON = '''
import pika
from typing import Annotated
router = APIRouter()

@router.get("/items/{item_id}")
def read_item(item_id: int, db = Depends(get_db)):
    return {"id": item_id}

@router.post("items")
async def create_item(payload: dict, *, db: Annotated[Session, Depends(get_db)]):
    return payload

@bp.route("/login", methods=["POST", "GET"])
def login_view():
    return "ok"

class UserModel(Base):
    __tablename__ = "users"
    def save(self):
        producer.send("orders.v1", b"x")

class DjangoProfile(models.Model):
    pass

@app.task(name="tasks.mail")
def mail(user_id):
    pass

@shared_task
def pay(amount):
    pass

def trigger():
    mail.delay(1)
    pay.apply_async(args=[1], queue="urgent")
    pay.delay(2)
    channel.basic_publish(exchange="", routing_key="notes", body=b"")
    r.publish("chat", "hi")
    other.publish("no topic")
    sqs.send_message(QueueUrl="https://sqs/1/jobs/")
    consumer = KafkaConsumer("orders.v1", "ignored")
    AIOKafkaConsumer(topics=["a", "b"])
    channel.basic_consume(queue="notes", on_message_callback=handle)
    pubsub.subscribe("chat")
    job_queue.receive_messages()

def handle(ch): pass
'''
SCRIPT = """
import { Kafka } from 'kafkajs';
await producer.send({ topic: 'orders', messages: [] });
await consumer.subscribe({ topic: 'orders', fromBeginning: true });
channel.sendToQueue('mail', Buffer.from(''));
channel.consume("mail", m => {});
redis.publish('chat', 'x');
const q = new Queue('reports');
const w = new Worker('reports', async job => {});
new SendMessageCommand({ QueueUrl: 'https://sqs/1/jobs' });
app.get('/health', checkHealth);
router.post('api/token', limit, generateToken);
@Controller('users')
export class UserController {
  constructor(private readonly svc: UserService, name: string) {}
  @Get(':id')
  async find(id) {}
  @Post()
  create() {}
}
@Controller()
class RootController {
  @Get('ping')
  ping() {}
}
@Injectable()
export class UserService {}
"""


def files(spark, rows):
    return spark.createDataFrame([(p, t.encode() if t is not None else None) for p, t in rows], "path string, content binary")


def test_semantics(spark):
    nodes, edges = semantics.semantics(files(spark, [("app.py", PYTHON), ("web.ts", SCRIPT), ("bad.py", "def ("), ("x.md", "app.get('/a', b)"), ("none.py", None)]))
    n = {r["id"]: (r["node_type"], r["detail"]) for r in nodes.collect()}
    assert n["endpoint:GET:/items/{item_id}"] == ("endpoint", "fastapi") and n["endpoint:POST:/items"] == ("endpoint", "fastapi") and n["endpoint:POST:/login"] == ("endpoint", "flask")
    assert n["table:users"] == ("table", "sqlalchemy") and n["table:djangoprofile"] == ("table", "django")
    assert n["endpoint:GET:/users/:id"] == ("endpoint", "nestjs") and "endpoint:POST:/users" in n and "endpoint:GET:/ping" in n and n["endpoint:POST:/api/token"] == ("endpoint", "express")
    topics = {k[6:]: v[1] for k, v in n.items() if v[0] == "topic"}
    assert topics == {"orders.v1": "kafka", "tasks.mail": "celery", "celery:pay": "celery", "urgent": "celery", "notes": "rabbitmq", "chat": "redis", "jobs": "sqs", "a": "kafka", "b": "kafka", "job_queue": "sqs", "orders": "kafka", "mail": "rabbitmq", "reports": "bullmq"}
    e = {(r["source_id"], r["target_id"], r["edge_type"]) for r in edges.collect()}
    f = "func:app.py:"
    assert {
        ("endpoint:GET:/items/{item_id}", f + "read_item", "routes_to"), (f + "read_item", "symbol:get_db", "injects"), (f + "create_item", "symbol:get_db", "injects"), ("class:app.py:UserModel", "table:users", "maps_to"),
        (f + "UserModel.save", "topic:orders.v1", "publishes"), (f + "trigger", "topic:orders.v1", "subscribes"), (f + "mail", "topic:tasks.mail", "subscribes"), (f + "trigger", "topic:tasks.mail", "publishes"),
        (f + "trigger", "topic:urgent", "publishes"), (f + "handle", "topic:notes", "subscribes"), (f + "trigger", "topic:jobs", "publishes"), (f + "trigger", "topic:job_queue", "subscribes"),
        ("endpoint:GET:/health", "func:web.ts:checkHealth", "routes_to"), ("endpoint:POST:/api/token", "func:web.ts:generateToken", "routes_to"), ("endpoint:GET:/users/:id", "func:web.ts:UserController.find", "routes_to"),
        ("endpoint:GET:/ping", "func:web.ts:RootController.ping", "routes_to"), ("file:web.ts", "symbol:UserService", "injects"), ("file:web.ts", "topic:reports", "subscribes"), ("file:web.ts", "topic:jobs", "publishes"),
    } <= e
    assert not any(t.endswith(("no topic", "ignored")) or t == "symbol:string" for _, t, _ in e)


def test_deep_code_is_no_error():
    from graphloom.sources import code

    deep = "import os\nx = " + "-" * 5_000 + "1\nf(" + "a." * 4_000 + "b)\n"
    assert semantics.python_semantics("a.py", deep) == [] and code.parse_python("a.py", deep)[0][1] == "file:a.py"


def test_manifests(spark):
    rows = [
        ("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  # note\n  - apps/web\nother:\n  - x\n"),
        ("package.json", json.dumps({"name": "root", "workspaces": {"packages": ["libs/*"]}})),
        ("packages/ui/package.json", json.dumps({"name": "@repo/ui", "dependencies": {"react": "1"}, "exports": {".": "./src/index.ts"}})),
        ("tsconfig.json", '{\n// paths\n"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./app/*"], "~": ["lib"],}},\n}'),
        ("crates/a/Cargo.toml", '[package]\nname = "a"\n[dependencies]\nserde = "1"\n[workspace]\nmembers = ["b", "c"]\n'),
        ("lerna.json", "not json"), ("x.txt", "{}"), ("none.json", None),
    ]
    m = packages.manifests(spark.createDataFrame(rows, "path string, text string"))
    assert sorted(tuple(r["items"]) for r in m.filter("kind = 'workspace'").collect()) == [("b", "c"), ("libs/*",), ("packages/*", "apps/web")]
    assert {r["prefix"]: r["target"] for r in packages.aliases(m).collect()} == {"@": "src/./app", "~": "src/lib", "root": "", "@repo/ui": "packages/ui", "a": "crates/a"}
    p = {r["name"]: r for r in packages.packages(m).collect()}
    assert p["@repo/ui"]["scope"] == "repo" and p["@repo/ui"]["exports"] == ["./src/index.ts"] and p["a"]["depends"] == ["serde"] and p["root"]["scope"] is None


def test_documents_and_capabilities(spark):
    md = "# Title\nStatus: **Accepted**\nMilestone: M2\n## Part One\ntext\n### Part Two\n# STORY-9: Pay\n- AC-1: ok\n- [x] T-1: do\n"
    f = spark.createDataFrame([("d.md", md), ("e.md", "no title"), ("z.md", "")], "path string, text string")
    nodes, edges = docs.sections(f)
    assert {(r["id"], r["name"]) for r in nodes.collect()} == {("doc:d.md", "Title"), ("doc:e.md", "e"), ("doc:z.md", "z"), ("section:d.md:part_one", "Part One"), ("section:d.md:part_two", "Part Two")}
    assert edges.count() == 2 and {(r["path"], r["status"], r["milestone"]) for r in docs.headers(f).collect()} == {("d.md", "Accepted", "M2"), ("e.md", None, None), ("z.md", None, None)}
    assert {(r["source_id"], r["target_id"]) for r in docs.specification_edges(docs.specifications(f)).collect()} == {("story:STORY-9", "criterion:STORY-9:AC-1"), ("story:STORY-9", "task:STORY-9:T-1")}
    c = capabilities.capabilities(spark)
    got = {r["path"]: r["coverage_tier"] for r in capabilities.family_of(spark.createDataFrame([("a.py",), ("b.TS",), ("c.zzz",), ("Makefile",)], "path string"), c).collect()}
    assert got == {"a.py": "full_ast", "b.TS": "limited_fallback", "c.zzz": None, "Makefile": None}


def test_stores(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert stores.load(spark, folder, "settings").count() == 0
    kv = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    stores.save(kv(("a", "1"), ("b", "2")), folder, "settings")
    stores.save(kv(("a", "3")), folder, "settings")
    assert {r["key"]: r["value"] for r in stores.load(spark, folder, "settings").collect()} == {"a": "3", "b": "2"}
    stores.remove(spark, folder, "settings", kv(("b", "")).select("key"))
    assert stores.load(spark, folder, "settings").count() == 1
    stores.remove(spark, folder, "settings")
    assert stores.load(spark, folder, "settings").count() == 0
    v = spark.createDataFrame([("n", 2, [0.5, -1.25]), ("m", 0, None)], "node_id string, dimension int, vector array<float>")
    stores.save(v, folder, "embeddings")
    assert {r["node_id"]: r["vector"] for r in stores.load(spark, folder, "embeddings").collect()} == {"n": [0.5, -1.25], "m": None}
    packed = stores.pack_vectors(v)
    assert packed.filter("node_id = 'n'").first()["vector"] == bytearray(b"\x00\x00\x00?\x00\x00\xa0\xbf")
    assert {r["node_id"]: r["vector"] for r in stores.unpack_vectors(packed).collect()} == {"n": [0.5, -1.25], "m": None}


def test_last_wins_carries_maps(spark):
    rows = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("b", 1, None)], "id string, o int, m map<string,string>")
    assert {r["id"]: r["m"] for r in sinks.last_wins(rows, "id", "o").collect()} == {"a": {"x": "2"}, "b": None}


def test_snapshot_keeps_manual_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    n = lambda *rows: spark.createDataFrame(list(rows), "id string, name string, node_type string, docstring string")
    e = lambda *rows: spark.createDataFrame(list(rows), "source_id string, target_id string, edge_type string")
    prints = spark.createDataFrame([("a.py", "h")], "path string, content_hash string")
    sinks.publish_snapshot(n(("f", "f", "function", None), ("s", "S", "story", None)), e(("s", "f", "implements"), ("f", "f", "calls")), folder, "one", prints)
    sinks.publish_snapshot(n(("g", "g", "function", None)), e(("g", "g", "calls")), folder, "two", keep_manual=True)
    nodes, edges = sinks.latest_snapshot(spark, folder)
    assert {r["id"] for r in nodes.collect()} == {"g", "s"} and {r["edge_type"] for r in edges.collect()} == {"implements", "calls"}
    assert sinks.without_embeddings(spark.createDataFrame([("f",), ("q",)], "node_id string"), spark.createDataFrame([("f", "a.py")], "id string, path string"), prints).count() == 1
    out = f"{tmp_path}/dot"
    sinks.write_dot(nodes, edges, f"file://{out}")
    text = "".join(r["value"] + "\n" for r in spark.read.text(f"{out}/*").collect())
    assert "digraph G {" in text and '"g" -> "g"' in text and sinks.to_json(nodes, edges).count() == 5
    assert [r["text"] for r in sinks.index_note(nodes).orderBy("place").collect()] == ["## function", "- [[g]] g", "## story", "- [[s]] S"]


def test_changes_as_a_stream(spark, tmp_path):
    src, folder = tmp_path / "src", f"file://{tmp_path}/st"
    src.mkdir()
    (src / "a.py").write_text("a")
    (src / "b.py").write_text("b")
    seen = []

    def index(batch, number):
        seen.append(sorted((r["path"].rpartition("/")[2], r["change"]) for r in batch.collect()))
        stores.save(batch, folder, "fingerprints")

    def run():
        q = changes.start_indexing(changes.file_stream(spark, f"file://{src}", "*.py"), lambda: stores.load(spark, folder, "fingerprints"), index, f"{tmp_path}/ck", {"availableNow": True})
        q.awaitTermination(120)

    run()
    (src / "c.py").write_text("c")
    run()
    assert seen == [[("a.py", "added"), ("b.py", "added")], [("c.py", "added")]]
    (src / "a.py").write_text("a2")
    (src / "b.py").unlink()
    again = []

    def reindex(rows, tick):
        again.append(sorted((r["path"].rpartition("/")[2], r["change"]) for r in rows.collect()))
        stores.save(rows.filter("change <> 'deleted'"), folder, "fingerprints")
        stores.remove(spark, folder, "fingerprints", rows.filter("change = 'deleted'").select("path"))

    q = changes.start_watching(spark, f"file://{src}", lambda: stores.load(spark, folder, "fingerprints"), reindex, f"{tmp_path}/ck3", "*.py")
    until = time.time() + 60
    while not again and time.time() < until:
        time.sleep(0.2)
    time.sleep(3)
    q.stop()
    assert again == [[("a.py", "modified"), ("b.py", "deleted")]]
    audit = lambda batch: batch.agg(F.when(F.count(F.lit(1)) > 1, "BLOCKED").otherwise("PASSED").alias("verdict"))
    assert changes.status(spark, f"file://{tmp_path}/guard").count() == 0
    changes.start_guard(changes.file_stream(spark, f"file://{src}"), audit, f"file://{tmp_path}/guard", f"{tmp_path}/ck2", {"availableNow": True}).awaitTermination(120)
    assert changes.status(spark, f"file://{tmp_path}/guard").first()["verdict"] == "BLOCKED"


def test_debounce_waits_for_quiet(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(list(rows), "path string, t string").select("path", F.to_timestamp("t").alias("modified")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("path string, modified timestamp").parquet(f"{tmp_path}/in")
        changes.debounced(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
        got = spark.read.schema("folder string, began timestamp, ended timestamp, paths array<string>").parquet(f"{tmp_path}/out").collect()
        return sorted((r["folder"], r["paths"], str(r["began"])[17:], str(r["ended"])[17:]) for r in got)

    day = "2024-01-01 00:0"
    first = [("x", ["x/a", "x/b"], "00", "00.800000"), ("x", ["x/c"], "05", "05.500000"), ("y/z", ["y/z/a"], "00.400000", "00.900000")]
    assert put(("x/a", day + "0:00.0"), ("x/b", day + "0:00.3"), ("y/z/a", day + "0:00.4"), ("x/c", day + "0:05"), ("x/d", day + "1:00"), (None, day + "1:00"), ("n", None)) == first
    # x/d waited in the checkpoint; a change within its quiet time joins it
    assert put(("x/e", day + "1:00.5"), ("top", day + "2:00")) == sorted([*first, ("x", ["x/d", "x/e"], "00", "01")])


def test_bursts_that_a_late_change_joins():
    from hypothesis import given
    from hypothesis import strategies as st

    @given(st.lists(st.integers(0, 60), min_size=1, max_size=12), st.data())
    def holds(times, data):
        whole = changes._merged([[t, t, {str(t)}] for t in times], 5)
        held = []
        for t in data.draw(st.permutations(times)):
            held = changes._merged([*held, [t, t, {str(t)}]], 5)
        assert held == whole and all(b[0] - a[1] > 5 for a, b in zip(whole, whole[1:])) and set().union(*(b[2] for b in whole)) == set(map(str, times))

    holds()


def test_cache(spark):
    calls = []

    def compute(new):
        calls.append(new.count())
        return new.select("key", F.upper("text").alias("content"))

    asked = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "text string")
    empty = spark.createDataFrame([], "key string, content string")
    answers, fresh = changes.through_cache(asked, empty, compute)
    assert answers.count() == 3 and calls == [3]
    again, more = changes.through_cache(asked, fresh, compute, most=1)
    assert again.filter("cached").count() == 3 and more.count() == 0
    # tokens: one for four characters of the text without secrets
    texts = spark.createDataFrame([("a" * n,) for n in (4, 8, 40, 80)] + [("AKIA" + "A" * 16,)], "text string")
    costs = {k: n for k, n in changes.through_cache(texts, empty, compute)[1].select("key", "tokens").collect()}
    assert sorted(costs.values()) == sorted(2 * max(1, n // 4) for n in (4, 8, 40, 80, len("[REDACTED_AWS_KEY]")))
    for budget in (0, 1, 15, 33, 100):
        total, want = 2, []
        for k in sorted(costs):
            total += costs[k] // 2
            want += [k] * (total <= budget)
        assert sorted(r["key"] for r in changes.through_cache(texts, empty, compute, most_tokens=budget, used=2)[1].collect()) == want


def test_ignore_files(spark, tmp_path):
    from graphloom.sources import code

    for f in ("a.py", "gen/b.py", "x/gen/c.py", "x/d_pb2.py", "x/e.py", "docs/f.py"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x = 1")
    (tmp_path / ".gitignore").write_text("# made\n/gen/\n*_pb2.py\n\ndocs\n!keep\n")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(code.scan(spark, str(tmp_path))) == ["a.py", "x/e.py"]
    assert len(paths(code.scan(spark, str(tmp_path), ()))) == 6 and paths(code.scan(spark, str(tmp_path), ("x",))) == ["a.py", "docs/f.py", "gen/b.py"]
