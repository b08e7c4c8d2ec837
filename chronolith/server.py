"""A thin HTTP facade over ``chronolith.api``: GET /<op>?session=..., POST /ask, GET /health."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from chronolith import api


def handler(spark: SparkSession) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            op, params = url.path.strip("/"), dict(parse_qsl(url.query))
            if op in ("", "health"):
                return self.answer(200, {"ok": True, "ops": [*api.PARAMS, "ask"]})
            if op == "ask":
                return self.asked({api.ALIASES.get(k, k): v for k, v in params.items()})
            if op not in api.OPS:
                return self.answer(404, {"error": f"unknown op {op}"})
            if "session" not in params:
                return self.answer(400, {"error": "session is missing"})
            try:
                self.answer(*api.call(api.load(spark, params.pop("session")), op, params))
            except Exception as e:  # a service answers; the error goes to the caller
                self.answer(500, {"error": str(e)})

        def do_POST(self) -> None:
            if self.path.strip("/") != "ask":
                return self.answer(404, {"error": "unknown path"})
            self.asked(json.loads(self.rfile.read(int(self.headers.get("Content-Length", "0"))) or b"{}"))

        def do_OPTIONS(self) -> None:
            self.answer(204, {})

        def asked(self, asked: dict) -> None:
            if "query" in asked:
                asked = {"question": asked["query"], **asked}
            if "session" not in asked or "question" not in asked:
                return self.answer(400, {"error": "session and question are needed"})
            try:
                self.answer(200, api.ask(api.load(spark, asked["session"]), asked["question"], int(asked.get("token_budget", 4000))))
            except Exception as e:
                self.answer(500, {"error": str(e)})

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(spark: SparkSession, port: int = 8765) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(spark))
