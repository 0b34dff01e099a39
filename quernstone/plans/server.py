"""A tool server: JSON-RPC 2.0 with the methods of the Model Context Protocol, over stdio or HTTP with a bearer token."""

from __future__ import annotations

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quernstone.plans import render
from quernstone.plans.service import Service, same_token

PROTOCOL = "2025-03-26"
# Error codes of JSON-RPC 2.0.
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
LIMIT = 8
BODY_BYTES = 1 << 20


def _text(what: str) -> dict:
    return {"type": "string", "description": what}


def _tool(name: str, description: str, required: dict, optional: dict | None = None) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": required | (optional or {}), "required": list(required)}}


LIVE = {"live": {"type": "boolean", "description": "read the page over HTTP (the default of a server)"}}
TOOLS = [
    _tool("search_docs", "Finds documentation topics by words and by meaning, in the latest release; each has a path to fetch.", {"query": _text("what to look for")}),
    _tool("fetch_doc", "A topic as Markdown, by its path.", {"path": _text("path of a search result")}, {"version": _text("a release; the latest by default"), **LIVE}),
    _tool("fetch_doc_by_url", "A topic as Markdown, by its address on the documentation site.", {"url": _text("address or reader path")}, LIVE),
    _tool("list_doc_versions", "The releases whose documentation is there, newest first.", {}),
]


class RpcError(Exception):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


class Server:
    """Answers messages. One at a time: each is a Spark job or a git call of its own."""

    def __init__(self, service: Service, live: bool = True):
        self.service, self.live, self.lock = service, live, threading.Lock()

    def call(self, name: str, arguments: dict) -> str:
        tool = next((t for t in TOOLS if t["name"] == name), None)
        if tool is None:
            raise RpcError(BAD_PARAMS, f"unknown tool {name!r}")
        schema = tool["inputSchema"]
        kinds = {"string": str, "boolean": bool}
        for k in schema["required"]:
            if k not in arguments:
                raise RpcError(BAD_PARAMS, f"{name} needs {k!r}")
        for k, v in arguments.items():
            if k in schema["properties"] and v is not None and not isinstance(v, kinds[schema["properties"][k]["type"]]):
                raise RpcError(BAD_PARAMS, f"{k!r} must be a {schema['properties'][k]['type']}")
        if name == "search_docs":
            return render.search_text(self.service.search(arguments["query"], LIMIT))
        if name == "list_doc_versions":
            return render.versions_text(self.service.list_versions())
        live = arguments.get("live")
        source = arguments["path" if name == "fetch_doc" else "url"]
        version = arguments.get("version") if name == "fetch_doc" else None
        return render.fetch_text(self.service.fetch(source, version, self.live if live is None else live))

    def method(self, name: str, params: dict) -> dict:
        if name == "initialize":
            return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "quernstone", "version": "0.1.0"}}
        if name == "ping":
            return {}
        if name == "tools/list":
            return {"tools": TOOLS}
        if name == "tools/call":
            arguments = params.get("arguments") or {}
            if not isinstance(params.get("name"), str) or not isinstance(arguments, dict):
                raise RpcError(BAD_PARAMS, "a call needs a name, and arguments as an object")
            with self.lock:
                return {"content": [{"type": "text", "text": self.call(params["name"], arguments)}], "isError": False}
        raise RpcError(NO_METHOD, f"unknown method {name!r}")

    def one(self, message) -> dict | None:
        """The answer to one message; None to a notification."""
        known = isinstance(message, dict) and message.get("jsonrpc") == "2.0" and isinstance(message.get("method"), str)
        to = message.get("id") if isinstance(message, dict) else None
        try:
            if not known:
                raise RpcError(INVALID, "no JSON-RPC 2.0 request")
            if "id" not in message:
                return None
            params = message.get("params") or {}
            if not isinstance(params, dict):
                raise RpcError(BAD_PARAMS, "parameters must be an object")
            return {"jsonrpc": "2.0", "id": to, "result": self.method(message["method"], params)}
        except RpcError as e:
            return {"jsonrpc": "2.0", "id": to, "error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # whatever a tool raises is told to the caller, and the server goes on
            return {"jsonrpc": "2.0", "id": to, "error": {"code": INTERNAL, "message": str(e) or type(e).__name__}}

    def answer(self, text: str | bytes) -> str | None:
        """The answer to a message or a batch of them, as text; None if nothing is to be sent."""
        try:
            message = json.loads(text)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "no JSON"}})
        if isinstance(message, list) and message:
            out = [a for a in map(self.one, message) if a is not None]
            return json.dumps(out, ensure_ascii=False) if out else None
        out = self.one(message)
        return None if out is None else json.dumps(out, ensure_ascii=False)

    def stdio(self, read=None, write=None) -> None:
        """One message a line, until the input ends."""
        read, write = read or sys.stdin, write or sys.stdout
        for line in read:
            if line.strip():
                out = self.answer(line)
                if out is not None:
                    write.write(out + "\n")
                    write.flush()

    def http(self, host: str, port: int, token: str) -> ThreadingHTTPServer:
        """A server that takes POST /mcp from callers with the bearer token; the caller runs serve_forever()."""
        if not token:
            raise ValueError("serving over HTTP needs a token")
        server = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, status: int, body: str = "") -> None:
                data = body.encode()
                self.send_response(status)
                if body:
                    self.send_header("Content-Type", "application/json")
                if status == 401:
                    self.send_header("WWW-Authenticate", "Bearer")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def allowed(self) -> bool:
                kind, _, given = self.headers.get("Authorization", "").partition(" ")
                if kind.lower() == "bearer" and same_token(given.strip(), token):
                    return True
                self.close_connection = True
                self.reply(401)
                return False

            def do_POST(self) -> None:
                if not self.allowed():
                    return
                size = self.headers.get("Content-Length", "")
                if self.path.split("?")[0].rstrip("/") != "/mcp":
                    self.reply(404)
                elif not size.isdigit() or int(size) > BODY_BYTES:
                    self.close_connection = True
                    self.reply(413 if size.isdigit() else 411)
                else:
                    out = server.answer(self.rfile.read(int(size)))
                    self.reply(202) if out is None else self.reply(200, out)

            def do_GET(self) -> None:
                if self.allowed():
                    self.reply(405)

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
