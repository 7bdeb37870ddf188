import json
import sys
import threading
import types
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import remote
from corpusloom.models import embedded
from corpusloom.operators import chat


@pytest.fixture
def server():
    """A stub of a chat server that answers by the name of the form asked for."""
    seen, failures = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            last = body["messages"][-1]["content"]
            answers = {
                "route": {"use_rag": "manual" in last, "rewritten_query": last.upper()},
                "answer": {"answer": f"re: {last[-20:]}", "references": [{"document_name": "a.docx", "images": ["a.png"]}]},
                "grades": {"feedback": "fine", "accuracy": 7, "completeness": 3, "relevance": 0},
            }
            status = failures.pop() if failures else 200
            content = "no object" if status == 299 else json.dumps(answers[body["response_format"]["json_schema"]["name"]])
            out = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(200 if status == 299 else status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    chat_server = remote.ChatServer(f"http://127.0.0.1:{http.server_port}/v1/", "some-model", key="secret")
    yield types.SimpleNamespace(chat=chat_server, seen=seen, failures=failures)
    http.shutdown()


def test_router_generator_judge(spark, server):
    none = F.array().cast("array<struct<role:string,content:string>>")
    rows = spark.createDataFrame([(1, "the manual?"), (2, "hello"), (3, None)], "id long, question string")
    routed = {r.id: r.r for r in rows.select("id", remote.ChatRouter(server.chat).route(F.col("question"), none).alias("r")).collect()}
    assert routed[1].use_rag and routed[1].rewritten_query == "THE MANUAL?"
    assert not routed[2].use_rag and routed[2].rewritten_query is None and not routed[3].use_rag
    prompt = chat.prompt(F.lit(True), F.array(chat.message("assistant", F.lit("earlier"))), F.col("question"))
    answered = {r.id: r.a for r in rows.select("id", remote.ChatGenerator(server.chat).answer(prompt).alias("a")).collect()}
    assert answered[2].answer == "re: hello" and answered[2].references[0].images == ["a.png"]
    judged = rows.select(remote.ChatJudge(server.chat).judge(F.col("question"), F.lit("x"), F.lit("y")).alias("j")).first().j
    assert tuple(judged) == ("fine", 5.0, 3.0, 1.0)
    path, key, body = server.seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer secret" and body["model"] == "some-model" and body["temperature"] == 0
    assert "secret" not in repr(server.chat)
    roles = [[m["role"] for m in b["messages"]] for _, _, b in server.seen if b["response_format"]["json_schema"]["name"] == "answer"]
    assert roles == [["system", "assistant", "user"]] * 3


def test_failures_are_tried_again(server):
    server.failures[:] = [503, 299]
    assert server.chat.ask([{"role": "user", "content": "manual"}], "route", remote.ROUTE)["use_rag"]
    assert len(server.seen) == 3
    server.failures[:] = [400]
    with pytest.raises(remote.Refused):
        server.chat.ask([{"role": "user", "content": "x"}], "route", remote.ROUTE)
    assert len(server.seen) == 4


def test_encoders_by_stub(spark, monkeypatch):
    """The package of the encoders isn't here; a stub stands for it in this process, and calls are made without Spark."""
    calls = []

    class SentenceTransformer:
        def __init__(self, model):
            calls.append(model)

        def encode(self, texts, prompt_name, normalize_embeddings):
            assert prompt_name == "query" and normalize_embeddings
            return [[1.0, 0.0] for _ in texts]

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=SentenceTransformer))
    remote._loaded.cache_clear()
    model = remote.SentenceEmbedder("some/model", 2)
    assert model.encode(["a", "b"]).shape == (2, 2) and model.encode([]).size == 0 and calls == ["some/model"]
    remote._loaded.cache_clear()
    assert embedded(model, F.lit("a")) is not None and remote.PairReranker("m").score(F.lit("a"), F.lit("b")) is not None
    assert np.array_equal(model.encode(["a"]), [[1.0, 0.0]])
