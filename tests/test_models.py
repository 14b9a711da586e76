import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from veilspark.functions import parsers
from veilspark.operators import ensemble, models, replace


class Fake(BaseHTTPRequestHandler):
    """Answers as a model would; refuses the JSON format, and breaks on 'boom'."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        system, user = (m["content"] for m in body["messages"])
        if "response_format" in body or "boom" in user:
            self.send_response(400 if "response_format" in body else 500)
            self.end_headers()
            return
        if system == models.FIND:
            say = 'Sure: [{"text": "Anna", "label": "Person"}, {"entity": "Anna", "type": "person"}, {"text": "x"}]'
        elif system == models.DECIDE:
            say = json.dumps({"verdicts": [{"id": x["id"], "is_pii": x["value"] == "Anna"} for x in json.loads(user)]})
        else:
            say = json.dumps({"replacements": [{"original_value": "Anna", "anonymized_value": "Eve", "pii_type": "person"}, {"original_value": "no", "anonymized_value": "x", "pii_type": "person"}, 3]})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": say}}]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def chat():
    server = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield models.Chat(f"http://127.0.0.1:{server.server_port}/", "any", timeout=20)
    server.shutdown()


def test_detect_judge_and_replace(spark, chat):
    chunks = spark.createDataFrame([(1, 1, "call Anna"), (2, 1, "boom"), (3, 1, " ")], "doc_id long, chunk_index int, chunk string").coalesce(1)
    found = models.ChatDetector(chat).apply(chunks)
    assert [(r.doc_id, r.text, r.label, r.score) for r in found.collect()] == [(1, "Anna", "person", 0.8)]
    asked = spark.createDataFrame([(1, 1, "Anna", "person", 0.5), (1, 1, "call", "person", 0.5)], "doc_id long, chunk_index int, value string, pii_type string, score double")
    assert [r.text for r in ensemble.judge(ensemble.judge_batches(asked, chunks), models.judge_with(chat)).collect()] == ["Anna"]
    offered = models.proposals(found, chunks, chat)
    assert [(r.original_value, r.anonymized_value) for r in replace.checked(offered, chunks).collect()] == [("Anna", "Eve")]


def test_a_reader_of_replies_used_before_a_model(spark, chat):
    replies = spark.createDataFrame([('so [{"a": 1}]',), (None,)], "reply string")
    read = replies.select(parsers.best_list_column(replies.reply).alias("b"), parsers.json_like_column(replies.reply).alias("j"))
    assert [(r.b, r.j) for r in read.collect()] == [('[{"a": 1}]', '{"result": [{"a": 1}]}'), ("[]", '{"error": "Empty text"}')]
    test_detect_judge_and_replace(spark, chat)


def test_replies():
    assert models.entities_of('{"spans": [{"value": "a", "entity_type": "B"}]}') == [("a", "b")]
    assert models.entities_of("nothing") == [] and models.entities_of('[{"text": "a", "label": "x"}]') == [("a", "x")]


def test_prompts_by_language_and_with_examples():
    assert models.replace_prompt("ar") == models.REPLACE_ARABIC != models.replace_prompt("fr") == models.REPLACE
    assert models.find_prompt() == models.FIND and "pan, as 'ABCDE1234F'" in models.find_prompt(models.EXAMPLES)
