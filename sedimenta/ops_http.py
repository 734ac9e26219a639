"""A small HTTP server of an engine's health, counters and recent statements."""

from __future__ import annotations

import html
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from sedimenta.session import Engine

ICON = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 8 8"><path d="M0 6h8v2H0zM1 3h6v2H1zM2 0h4v2H2z"/></svg>'


def page(status: dict) -> str:
    """The status as a page for people."""
    rows = "".join(f"<tr><td>{html.escape(r['sql'][:200])}<td>{r['seconds']}<td>{r['rows']}<td>{html.escape(r['error'] or '')}" for r in reversed(status["recent"]))
    facts = "".join(f"<li>{k}: {html.escape(str(v))}" for k, v in status.items() if k != "recent")
    return f"<!doctype html><title>sedimenta</title><ul>{facts}</ul><table><tr><th>statement<th>seconds<th>rows<th>error{rows}</table>"


def answer(engine: Engine, path: str) -> tuple[int, str, str]:
    """(code, content type, body) for a path."""
    status = engine.metrics.status(engine.sessions)
    if path == "/healthz":
        return 200, "text/plain", "ok"
    if path == "/readyz":
        return (200, "text/plain", "ready") if status["ready"] else (503, "text/plain", "not ready")
    if path == "/metrics":
        return 200, "text/plain; version=0.0.4", engine.metrics.text(engine.sessions)
    if path == "/status.json":
        return 200, "application/json", json.dumps(status)
    if path in ("/", "/status"):
        return 200, "text/html", page(status)
    if path == "/favicon.svg":
        return 200, "image/svg+xml", ICON
    return 404, "text/plain", "not found"


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serve in a thread; ``shutdown()`` of what is returned ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            code, kind, body = answer(engine, self.path.split("?")[0])
            raw = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
