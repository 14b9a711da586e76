import json
import os
import subprocess
import sys
import textwrap
import threading
import time
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect, models, replace
from veilspark.workers import calls, children, stub

#: A child that does as it is told, and writes its number to a file.
SOURCE = """
import json, os, sys, time
open(sys.argv[1] + "/" + str(os.getpid()), "w").close()
for line in sys.stdin:
    r = json.loads(line)
    do = r.get("do") or ""
    if do == "hang":
        time.sleep(1000)
    if do == "crash":
        os._exit(3)
    if do == "slow":
        time.sleep(0.2)
    if do == "noise":
        print(json.dumps({"id": r["id"] - 1, "late": True}), flush=True)
    if do == "prose":
        print("no JSON", flush=True)
        continue
    print(json.dumps({"id": r["id"], "said": r.get("x")}), flush=True)
"""


@pytest.fixture
def command(tmp_path):
    script, pids = tmp_path / "child.py", tmp_path / "pids"
    script.write_text(SOURCE)
    pids.mkdir()
    yield [sys.executable, str(script), str(pids)]
    end = time.time() + 10
    while time.time() < end and (left := [p for p in os.listdir(pids) if os.path.exists(f"/proc/{p}")]):
        time.sleep(0.1)
    assert not left, "children were left behind"


def test_hanging_crashing_slow_and_talkative_children(spark, command):
    does = ["", "slow", "hang", "", "crash", "noise", "prose", None, "slow", "", "é\n"]
    df = spark.createDataFrame([(i, d, f"x{i}\n") for i, d in enumerate(does)], "i int, do string, x string").coalesce(1)
    request = F.when(F.col("do").isNotNull(), F.struct("do", "x"))
    got = children.answered(df, request, command, timeout=1.0).collect()
    assert [r.i for r in got] == list(range(len(does)))
    for r, d in zip(got, does):
        if d in ("hang", "crash", "prose"):
            assert r.answer is None and {"hang": "no answer within 1 seconds", "crash": "ended: 3", "prose": "not JSON"}[d] in r.error
        elif d is None:
            assert r.answer is None and r.error is None
        else:
            assert json.loads(r.answer)["said"] == r.x and r.error is None


def test_children_side_by_side_keep_the_order_and_stay(spark, command):
    df = spark.range(40).select(F.col("id").alias("i"), F.lit("slow").alias("do"), F.col("id").cast("string").alias("x")).coalesce(1)
    began = time.time()
    got = children.answered(df, F.struct("do", "x"), command, timeout=10, at_once=8).collect()
    assert [json.loads(r.answer)["said"] for r in got] == [str(i) for i in range(40)] and time.time() - began < 8
    assert 1 < len(os.listdir(command[2])) <= 8


def test_children_end_with_a_task_that_is_cut(spark, command):
    df = spark.range(1000).select(F.lit("slow").alias("do"), F.col("id").cast("string").alias("x"))
    assert children.answered(df, F.struct("do", "x"), command).limit(2).count() == 2


def test_a_command_that_is_not_there(spark):
    df = spark.createDataFrame([("a",)], "x string")
    (r,) = children.answered(df, F.struct("x"), ["/no/such/command"]).collect()
    assert r.answer is None and "FileNotFoundError" in r.error
    assert children.answered(df.limit(0), F.struct("x"), ["/no/such/command"]).collect() == []


def test_large_requests_and_answers(command):
    with children.Children(command, 20) as c:
        assert len(c.ask({"x": "é" * 500_000})["said"]) == 500_000


def test_the_stub_replaces_and_its_values_are_checked(spark):
    chunks = spark.createDataFrame([(1, 1, "mail asha@example.com, call 555-0100"), (2, 1, "nothing")], "doc_id long, chunk_index int, chunk string")
    found = spark.createDataFrame([(1, 1, "asha@example.com", "email", 0.9), (1, 1, "555-0100", "phone number", 0.9)], "doc_id long, chunk_index int, text string, label string, score double")
    offered = models.proposals_by_command(found, chunks, [sys.executable, "-m", "veilspark.workers.stub"], timeout=30).collect()
    made = {r.original_value: r.anonymized_value for r in offered}
    assert made == {v: stub.reshaped(v) for v in ("asha@example.com", "555-0100")}
    kept = replace.checked(spark.createDataFrame(offered), chunks)
    assert kept.count() == 2


def test_the_stub_alone():
    assert stub.reshaped("Ab-1é") != "Ab-1é" and [c.isdigit() for c in stub.reshaped("Ab-1é")] == [False] * 3 + [True, False]
    assert stub.reshaped("x" * 100) == stub.reshaped("X" * 100).lower() and stub.reshaped("") == ""
    prompt = 'Detected:\n[oops\n[{"value": "Ann", "pii_type": ""}, {"value": "ANN", "pii_type": "unknown"}, 3, {"value": " "}]\n\nText:\n[]'
    said = subprocess.run([sys.executable, "-m", "veilspark.workers.stub"], input=f"no JSON\n{json.dumps({'id': 4, 'user_prompt': prompt})}\n{{}}\n", capture_output=True, text=True, timeout=30).stdout
    first, second, third = map(json.loads, said.splitlines())
    assert "error" in first and third == {"replacements": []}
    assert second == {"id": 4, "replacements": [{"original_value": "Ann", "anonymized_value": stub.reshaped("Ann"), "pii_type": "unknown"}]}


def test_a_recogniser_in_a_child(spark, tmp_path):
    script = tmp_path / "find.py"
    script.write_text(textwrap.dedent("""
        import json, re, sys
        for line in sys.stdin:
            r = json.loads(line)
            if "boom" in r["text"]:
                sys.exit(1)
            spans = [{"start": m.start(), "end": m.end(), "entity_type": "PERSON", "score": 0.9} for m in re.finditer("Asha|Rao", r["text"])]
            spans += [{"start": 5, "end": 2, "entity_type": "X", "score": 1}, {"start": 0, "end": 1, "entity_type": "ODD_KIND", "score": 0.1}]
            print(json.dumps(spans if "list" in r["text"] else {"id": r["id"], "result": spans}), flush=True)
    """))
    texts = ["é Asha met Rao, Asha", "boom", "list of Rao", "", None]
    chunks = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, chunk_index int, chunk string").coalesce(1)
    d = models.CommandDetector([sys.executable, str(script)], timeout=20)
    got = [(r.doc_id, r.text, r.label) for r in d.apply(chunks).orderBy("doc_id", "pos").collect()]
    assert got == [(0, "Asha", "person"), (0, "Rao", "person"), (2, "Rao", "person")]
    tried = d.tried(chunks).collect()
    assert [r.doc_id for r in tried if r.error] == [1, 4] or [r.doc_id for r in tried if r.error] == [1]
    assert d.apply(chunks, 0.0).where("label = 'odd kind'").count() >= 1


def test_outcomes_in_order_and_bounded():
    now, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01 * (5 - x % 5))
        with lock:
            now[0] -= 1
        return x if x % 7 else 1 / 0

    got = list(calls.side_by_side(range(50), call, 6))
    assert [x for x, why in got if not why] == [x for x in range(50) if x % 7] and most[0] <= 6
    assert got[0][0] is None and "ZeroDivisionError" in got[0][1]


class Busy(BaseHTTPRequestHandler):
    """Takes 50 ms, and refuses every text's first call with 429."""

    protocol_version = "HTTP/1.1"
    seen: dict = {}
    refuse = False

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        user = body["messages"][1]["content"]
        time.sleep(0.05)
        n = self.seen[user] = self.seen.get(user, 0) + 1
        code = 429 if self.refuse and n == 1 else 500 if "boom" in user else 200
        say = json.dumps({"entities": [{"text": user.split()[-1], "label": "full name"}, {"text": user.split()[-1].upper(), "label": "Full Name"}]})
        data = json.dumps({"choices": [{"message": {"content": say}}]}).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


class Server(ThreadingHTTPServer):
    request_queue_size = 128


@pytest.fixture
def busy():
    Busy.seen, Busy.refuse = {}, False
    server = Server(("127.0.0.1", 0), Busy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_two_hundred_calls_side_by_side(busy):
    d = models.ChatDetector(models.Chat(busy, "any", at_once=16))
    began = time.time()
    got = d.each([f"call Name{i}" for i in range(200)])
    assert [g[0][0][0] for g in got] == [f"Name{i}" for i in range(200)] and time.time() - began < 3


def test_a_busy_endpoint_is_asked_again(busy):
    Busy.refuse = True
    chat = models.Chat(busy, "any", back_off=0.01)
    assert models.ChatDetector(chat).each(["call Ann"])[0][0][0][0] == "Ann" and Busy.seen == {"call Ann": 2}
    with pytest.raises(urllib.error.HTTPError):
        models.Chat(busy, "any", tries=1).ask("s", "call Bob")
    assert "500" in models.ChatDetector(chat).each(["boom x"])[0][1] and Busy.seen["boom x"] == 2
    with pytest.raises(urllib.error.URLError):
        models.Chat("http://127.0.0.1:9/", "any", tries=2, back_off=0.01).ask("s", "x")


def test_labels_are_ours_and_patterns_add_what_a_model_misses(spark, busy):
    chunks = spark.createDataFrame([(1, 1, "PAN ABCDE1234F of Asha"), (2, 1, "boom ABCDE1234F x"), (3, 1, "")], "doc_id long, chunk_index int, chunk string").coalesce(1)
    d = models.ChatDetector(models.Chat(busy, "any"))
    got = {(r.doc_id, r.text, r.label) for r in d.apply(chunks).collect()}
    assert (1, "Asha", "name") in got and len([g for g in got if g[1].lower() == "asha"]) == 1
    assert any(g[0] == 1 and g[1] == "ABCDE1234F" for g in got) and not any(g[0] == 2 for g in got)
    assert [r.doc_id for r in d.tried(chunks).collect() if r.error] == [2]


def test_a_long_chunk_is_asked_about_in_pieces(busy):
    d = models.ChatDetector(models.Chat(busy, "any"))
    d.piece, d.overlap = 30, 5
    text = " ".join(f"word{i:03d}" for i in range(20))
    found = [t for t, _, _ in d._one(text)]
    assert len(Busy.seen) == len(range(0, len(text) - 5, 25)) and found[-1].lower() == "word019"
    assert all(x in text for x in Busy.seen) and "".join(sorted(Busy.seen, key=text.index)[0]) == text[:30]


def test_all_recognisers_in_one_pass(spark):
    df = spark.createDataFrame([(1, 1, "a@b.com 4111 1111 1111 1111 http://x.org 10.0.0.1 a@b.com"), (2, 1, None)], "doc_id long, chunk_index int, chunk string")
    each = [r for n in detect.vocab.RECOGNISERS for r in detect.recognise(df, n).collect()]
    assert sorted(map(str, detect.recognise_all(df).collect())) == sorted(map(str, each)) and len(each) >= 3
