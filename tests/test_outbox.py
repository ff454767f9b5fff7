"""Messages leave once: over reruns, restarts, refusals and deliveries that died."""

import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from weftgraph.graph import Graph
from weftgraph.stage import new_path
from weftgraph.streaming import outbox as O


@pytest.fixture()
def receiver():
    got, refuse = [], set()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            status = 503 if body["data"]["entity"] in refuse else 200
            got.append((body["data"]["entity"], body["event"], self.headers["Idempotency-Key"], status))
            self.send_response(status)
            self.end_headers()

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", got, refuse
    s.shutdown()


def alerts(spark, *ids):
    ts = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return O.alert_messages(spark.createDataFrame([(i, ts, 80.0, 75.0) for i in ids], "id string, ts timestamp, score double, threshold double"))


def test_no_alert_twice_over_a_restart(spark, receiver):
    url, got, refuse = receiver
    root = new_path(spark, "outbox")
    send = O.webhook({"tension_threshold_crossed": [url]})
    box = lambda: O.Outbox(spark, root, tries=2, tries_in_all=4, pause=0)
    refuse.add("C")
    for _ in range(2):  # a batch that is run again
        box().put(0, alerts(spark, "A", "B", "B", "C"))
    dies = box()
    dies.outcomes.write = lambda *_: (_ for _ in ()).throw(RuntimeError("crash"))
    rows = dies.state()
    assert {r.status for r in rows.collect()} == {"waiting"}
    assert {r.subject: r.status for r in box().deliver(send).join(rows.select("id", "subject"), "id").collect()} == {"A": "sent", "B": "sent", "C": "failed"}
    assert sorted(x[0] for x in got) == ["A", "B", "C", "C"]
    box().put(1, alerts(spark, "A", "D"))  # a later alert of the same subject is another one
    claims = box().claims
    due = box().state().filter("status = 'waiting'").select("id")
    claims.write(claims.batches() + 1, due)  # a delivery that died after it claimed
    assert {r.subject: r.status for r in box().state().collect() if r.status == "in doubt"} == {"A": "in doubt", "D": "in doubt"}
    got.clear()
    box().deliver(send)
    assert sorted(x[0] for x in got) == ["C", "C"]  # bounded in all
    assert {r.subject: (r.status, r.tries) for r in box().state().collect() if r.subject == "C"} == {"C": ("dead", 4)}
    got.clear()
    box().deliver(send)
    assert got == []
    box().deliver(send, in_doubt=True)
    assert sorted(x[0] for x in got) == ["A", "D"] and len({x[2] for x in got}) == 2
    assert sorted(r.subject for r in box().since(0).collect()) == ["A", "D"] and box().since(1).count() == 0
    box().acknowledge(box().state().filter("subject = 'D'"))
    assert {(r.subject, r.acknowledged) for r in box().state().filter("subject in ('D', 'B')").collect()} == {("D", True), ("B", False)}


def test_messages_of_changes(spark):
    g = Graph.literal(spark, [("A", "x"), ("B", None)], [("A", "B", "l")])
    got = [(r.event, r.subject, json.loads(r.payload)) for r in O.delta_messages(g, datetime(2024, 1, 1)).collect()]
    assert sorted(x[:2] for x in got) == [("edge_added", "A>B"), ("node_added", "A"), ("node_added", "B")]


def test_events_are_written_once_per_batch(spark, tmp_path):
    O.register(spark)
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "id string, event string, data string"
    for i, rows in enumerate([[("1", "a", "x\ny"), ("2", None, "")], [("3", "b", None), (None, "c", "data: z")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = spark.readStream.schema(schema).parquet(src).writeStream.format("weft_sse").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted((r.batch, r.id, r.event, r.data) for r in O.sse_events(spark, out).collect() if r.id)
    assert got == [(0, "1", "a", "x\ny"), (0, "2", None, ""), (1, "3", "b", "")]
    writer = O.SseWriter({"path": out})
    again = writer.write(iter([{"id": "9", "event": "late", "data": "x"}]))
    writer.commit([again, O.Written(None, 0), None], 1)  # a batch that is done already
    new = writer.write(iter([{"id": "8", "event": "new", "data": "x"}]))
    writer.commit([new], 2)
    writer.abort([writer.write(iter([{"id": "7", "event": "lost", "data": "x"}]))], 3)
    assert sorted(r.id for r in O.sse_events(spark, out).filter("id > '3'").collect()) == ["8"]
    assert not list((tmp_path / "out" / ".aside").iterdir())


def test_a_commit_that_died_is_made_again(spark, tmp_path):
    out = tmp_path / "out"
    (out / "batch=000000000000").mkdir(parents=True)
    (out / "batch=000000000000" / "part-00000.sse").write_text("id: old\ndata: x\n\n")
    assert O.sse_frame("a\nb", "e", "1\n2") == "id: a b\nevent: e\ndata: 1\ndata: 2\n\n"
    writer = O.SseWriter({"path": str(out)})
    writer.commit([writer.write(iter([{"id": "new", "event": "e", "data": "x"}]))], 0)
    assert [r.id for r in O.sse_events(spark, str(out)).collect()] == ["new"]
