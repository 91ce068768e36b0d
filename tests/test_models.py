import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import Observation

from corpusgraph.operators.answer import answer, watch_private
from corpusgraph.operators.rules import BLOCK_MESSAGE
from corpusgraph.sources import models as M


class Server(BaseHTTPRequestHandler):
    speaks = "openai"

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status, out = 404, {"error": "no such path"}
        if self.path == "/v1/chat/completions" and self.speaks == "openai":
            status, out = 200, {"choices": [{"message": {"content": [{"text": "it adds "}, {"text": body["messages"][0]["content"][:4]}]}}]}
        if self.path == "/v1/messages" and self.speaks == "anthropic":
            status, out = 200, {"content": [{"text": "key " + self.headers.get("x-api-key", "none")}]}
        if self.path == "/v1/embeddings":
            texts = [body["input"]] if isinstance(body["input"], str) else body["input"]
            status, out = (413, {"error": {"message": "input too large"}}) if max(map(len, texts)) > 900 else (200, {"data": [{"embedding": [len(t), 1], "index": n} for n, t in enumerate(texts)][::-1]})
        data = json.dumps(out).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture
def url():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def test_dialects(url):
    Server.speaks = "openai"
    m = M.ChatModel(url, "m").detected()
    assert m.dialect == "openai" and m("ping please") == "it adds ping"
    Server.speaks = "anthropic"
    assert M.ChatModel(url, "m", "k")("x") == "key k"
    Server.speaks = "neither"
    assert M.ChatModel(url, "m").detected().dialect == "openai"  # asked once
    for _ in range(2):
        with pytest.raises(RuntimeError):
            M.ChatModel(url, "other").detected()
    with pytest.raises(RuntimeError):
        M.ChatModel("http://127.0.0.1:9", "m", dialect="openai")("x")


def test_embeddings(url):
    assert M.EmbeddingModel(url, "e")(["abc", "y" * 1000]) == [[3.0, 1.0], [(900 + 220) / 2, 1.0]]
    assert M.EmbeddingModel(url, "e")(["x" * n for n in range(1, 40)]) == [[float(n), 1.0] for n in range(1, 40)]
    assert M.mean_of([[1, 3], [3, 5]]) == [2, 4]
    assert M.Reply(413, "TOKEN limit").too_long and not M.Reply(200, "too large").too_long and not M.Reply(400, "token").too_long
    assert M.pieces_of(" ") == [] and [len(p) for p in M.pieces_of("x" * 1681)] == [900, 900, 121]


def test_answers(spark):
    hits = spark.createDataFrame([("q", 1, "t", "a.py", 1, 2, "function", "P", "python", True, "s")], "query_id string, rank int, text string, file_path string, line_start int, line_end int, chunk_type string, project_name string, language string, is_private boolean, privacy_summary string")
    o = Observation("private")
    assert watch_private(hits, o).count() == 1 and o.get == {"n_hits": 1, "n_private": 1}
    assert answer(hits, "Why?").first().answer is None
    assert answer(hits, "Why?", lambda p: "It waits.").first().answer == "It waits."
    assert answer(hits, "Why?", lambda p: "```code```").first().answer == BLOCK_MESSAGE

    def broken(p):
        raise RuntimeError

    assert answer(hits, "Why?", broken).first().answer == "The model gave no answer."
