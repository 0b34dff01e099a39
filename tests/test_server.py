"""The tool server over stdio and HTTP, with a stand-in for the service."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from quernstone.plans import render, server


class Library:
    def __init__(self):
        self.asked = []

    def search(self, query, limit):
        self.asked.append((query, limit))
        if query == "broken":
            raise FileNotFoundError("no index")
        return []

    def fetch(self, source, version=None, live=False):
        self.asked.append((source, version, live))
        return {"markdown": "text é", "source_url": "u", "path": source, "release": version or "v2"}

    def list_versions(self):
        return [{"release": "v2", "is_latest": True}]


def ask(made, method, params=None, **more):
    return json.loads(made.answer(json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params or {}, **more})))


def call(made, name, **arguments):
    return ask(made, "tools/call", {"name": name, "arguments": arguments})


def test_tools():
    library = Library()
    made = server.Server(library)
    assert ask(made, "initialize", {"protocolVersion": "x"})["result"]["protocolVersion"] == "x"
    assert [t["name"] for t in ask(made, "tools/list")["result"]["tools"]] == ["search_docs", "fetch_doc", "fetch_doc_by_url", "list_doc_versions"]
    text = lambda answer: answer["result"]["content"][0]["text"]
    assert text(call(made, "search_docs", query="flow")) == render.NO_HITS
    assert text(call(made, "fetch_doc", path="a.md", version="v1")) == "> Source: u (release: v1)\n\ntext é"
    assert "(release: v2)" in text(call(made, "fetch_doc_by_url", url="https://h/a", live=False))
    assert "- v2  (latest)" in text(call(made, "list_doc_versions"))
    assert library.asked == [("flow", 8), ("a.md", "v1", True), ("https://h/a", None, False)]


@pytest.mark.parametrize(
    ("method", "params", "code"),
    [
        ("nothing", {}, server.NO_METHOD), ("tools/call", {"name": "nothing"}, server.BAD_PARAMS), ("tools/call", {"name": "search_docs"}, server.BAD_PARAMS),
        ("tools/call", {"name": "search_docs", "arguments": {"query": 3}}, server.BAD_PARAMS), ("tools/call", {}, server.BAD_PARAMS),
        ("tools/call", {"name": "search_docs", "arguments": {"query": "broken"}}, server.INTERNAL),
    ],
)
def test_errors(method, params, code):
    assert ask(server.Server(Library()), method, params)["error"]["code"] == code


def test_stdio():
    lines = ["{", "", "[]", json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps([{"jsonrpc": "2.0", "id": 1, "method": "ping"}, {"jsonrpc": "2.0", "method": "x"}, 5])]
    out = io.StringIO()
    server.Server(Library()).stdio(io.StringIO("\n".join(lines) + "\n"), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["error"]["code"] for a in answers[:2]] == [server.PARSE, server.INVALID]
    assert answers[2][0] == {"jsonrpc": "2.0", "id": 1, "result": {}} and answers[2][1]["error"]["code"] == server.INVALID and len(answers) == 3


def test_http():
    with pytest.raises(ValueError):
        server.Server(Library()).http("127.0.0.1", 0, "")
    listening = server.Server(Library()).http("127.0.0.1", 0, "secret")
    threading.Thread(target=listening.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{listening.server_port}"

    def send(path="/mcp", token="Bearer secret", body=b'{"jsonrpc": "2.0", "id": 1, "method": "ping"}', method="POST"):
        request = urllib.request.Request(base + path, data=body if method == "POST" else None, headers={"Authorization": token} if token else {}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=10) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, b""

    assert send()[0] == 200 and json.loads(send()[1])["result"] == {}
    assert [send(token=t)[0] for t in ("", "Bearer x", "Basic secret")] == [401, 401, 401]
    assert send(path="/other")[0] == 404 and send(method="GET")[0] == 405
    assert send(body=b'{"jsonrpc": "2.0", "method": "notifications/x"}') == (202, b"")
    listening.shutdown()
    listening.server_close()
