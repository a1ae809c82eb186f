"""The engine over lines of JSON and over HTTP."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from lectern.plans.engine import Engine, answer

MOST_BYTES = 1 << 20


def run_lines(engine: Engine, source: TextIO, sink: TextIO) -> None:
    """A reply line for each request line, until the source ends; a bad line gets an error and the next one
    is read."""
    for line in source:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as e:
            reply = {"id": None, "ok": False, "error": f"not JSON: {e}"}
        else:
            reply = answer(engine, request)
        sink.write(json.dumps(reply, ensure_ascii=False, default=str) + "\n")
        sink.flush()


def http_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """GET /health, and POST /query with a request of the line protocol."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value: object) -> None:
            body = json.dumps(value, ensure_ascii=False, default=str)
            body = body.encode()
            self.send_response(status)
            for header in {"Content-Length": len(body), "Content-Type": "application/json"}.items():
                self.send_header(header[0], str(header[1]))
            self.end_headers()
            self.wfile.write(body)
            self.wfile.flush()

        def do_GET(self) -> None:
            self._send(200, {"status": "ok"}) if self.path == "/health" else self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/query":
                return self._send(404, {"error": "not found"})
            if size > MOST_BYTES:
                return self._send(413, {"error": "the request is too long"})
            try:
                request = json.loads(self.rfile.read(size))
            except ValueError:
                return self._send(400, {"error": "not JSON"})
            reply = answer(engine, request)
            self._send(200 if reply["ok"] else 400, reply)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
