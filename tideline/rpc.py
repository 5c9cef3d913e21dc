"""The store as tools over JSON-RPC 2.0, a line a request.

Each tool is one entry of TOOLS: a schema, which is both what clients are shown and what arguments are held against, and
the call it makes on the engine.  Methods are one table, too.  A tool that raises gives a result marked as an error; only
requests that can't be dispatched give error responses; notifications are read and left alone.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from .engine import Engine
from .functions import model

#: The protocol's version and JSON-RPC's error codes.
VERSION = "2024-11-05"
CODES = {"parse": -32700, "request": -32600, "method": -32601, "params": -32602, "internal": -32603}


def text(**more) -> dict:
    return {"type": "string", **more}


def count() -> dict:
    return {"type": "integer", "minimum": 0}


def flag() -> dict:
    return {"type": "boolean"}


def named() -> dict:
    """A text that says something: an id or a content."""
    return text(minLength=1, pattern=r"\S")


@dataclass(frozen=True)
class Tool:
    fields: dict[str, dict]
    needs: tuple[str, ...]
    call: Callable[[Engine, dict], dict]
    writes: bool = True

    def schema(self) -> dict:
        return {"type": "object", "properties": self.fields, "required": list(self.needs), "additionalProperties": False}


def recalled(e: Engine, a: dict) -> dict:
    r = e.recall(a.get("budget", model.BUDGET), query=a.get("query"), force_similarity=a.get("force_similarity"))
    return {"text": r.text, "used_ids": r.used_ids, "ranked_ids": r.ranked_ids[:10], "tiers": r.tiers, "chars": r.chars, "budget": r.budget}


def done(call: Callable[[Engine, dict], bool]) -> Callable[[Engine, dict], dict]:
    return lambda e, a: {"ok": call(e, a), "id": a["id"]}


#: Names of tools and of their fields are fixed values.
TOOLS = {
    "memory_add": Tool({"content": named(), "category": text(), "protected": flag(), "supersedes": named()}, ("content",), lambda e, a: {"id": e.add(**a)}),
    "memory_access": Tool({"id": named()}, ("id",), done(lambda e, a: e.access(a["id"]))),
    "memory_retire": Tool({"id": named(), "superseded_by": named()}, ("id",), done(lambda e, a: e.retire(a["id"], a.get("superseded_by")))),
    "memory_pin": Tool({"id": named()}, ("id",), done(lambda e, a: e.pin(a["id"]))),
    "memory_recall": Tool({"query": text(), "budget": count(), "force_similarity": flag()}, (), recalled, writes=False),
    "memory_refresh": Tool({"max_entries": count()}, (), lambda e, a: e.refresh(**a)),
    "memory_stats": Tool({}, (), lambda e, a: e.stats(), writes=False),
}


def faults(value: object, schema: dict) -> Iterator[str]:
    """What of a schema a value breaks: the small part of JSON Schema that tools use."""
    match schema["type"], value:
        case "object", dict():
            yield from (f"{k} is required" for k in schema["required"] if k not in value)
            for k, v in value.items():
                part = schema["properties"].get(k)
                yield from (f"{k} {x}" for x in (faults(v, part) if part else ["is not a field"]))
        case ("boolean", bool()) | ("string", str()):
            if "pattern" in schema and not str(value).strip():
                yield "is blank"
        case "integer", int() if not isinstance(value, bool):
            if value < schema["minimum"]:
                yield f"is below {schema['minimum']}"
        case kind, _:
            yield f"is not of type {kind}"


class Refused(Exception):
    """A request that gets an error response."""

    def __init__(self, why: str, message: str):
        super().__init__(message)
        self.error = {"code": CODES[why], "message": message}


class Server:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.methods: dict[str, Callable[[dict], dict]] = {"initialize": self.hello, "ping": lambda _: {}, "tools/list": self.listed, "tools/call": self.called}

    def hello(self, _: dict) -> dict:
        return {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "tideline", "version": "1"}}

    def listed(self, _: dict) -> dict:
        return {"tools": [{"name": n, "inputSchema": t.schema()} for n, t in TOOLS.items()]}

    def called(self, params: dict) -> dict:
        name, arguments = params.get("name"), params.get("arguments", {})
        tool = TOOLS.get(name) if isinstance(name, str) else None
        wrong = list(faults(arguments, tool.schema())) if tool else [f"there is no tool {name}"]
        if wrong:
            raise Refused("params", "; ".join(wrong))
        try:
            said, failed = tool.call(self.engine, arguments), False
            if tool.writes and self.engine.path:
                self.engine.save()
        except Exception as x:  # the tool's own failure
            said, failed = str(x), True
        return {"content": [{"type": "text", "text": said if failed else json.dumps(said, sort_keys=True)}], "isError": failed}

    def answer(self, request: object) -> dict | None:
        """The response to one request; None to a notification."""
        key = request.get("id") if isinstance(request, dict) else None
        if isinstance(key, (bool, dict, list)) or key != key or key in (float("inf"), float("-inf")):
            key, request = None, None  # an id that no response can carry
        reply = {"jsonrpc": "2.0", "id": key}
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return reply | {"error": Refused("request", "this is no request").error}
        if "id" not in request:
            return None
        try:
            method, params = self.methods.get(request["method"]), request.get("params", {})
            if not method:
                raise Refused("method", f"there is no method {request['method']}")
            if not isinstance(params, dict):
                raise Refused("params", "params is not of type object")
            return reply | {"result": method(params)}
        except Refused as r:
            return reply | {"error": r.error}
        except Exception as x:
            print(f"{request['method']} failed: {x!r}", file=sys.stderr)
            return reply | {"error": Refused("internal", "the server failed").error}

    def line(self, raw: str) -> str | None:
        if raw.isspace() or not raw:
            return None
        try:
            request = json.loads(raw)
        except (ValueError, RecursionError):
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": Refused("parse", "the line is not JSON").error})
        reply = self.answer(request)
        return reply and json.dumps(reply)

    def serve(self, lines: Iterable[str] | None = None, out=None) -> None:
        for reply in filter(None, map(self.line, lines or sys.stdin)):
            print(reply, file=out or sys.stdout, flush=True)
