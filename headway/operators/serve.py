"""The line tools over standard input and output: JSON-RPC, a message a line, as tool servers speak it."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import IO

from headway.operators.agent import ToolBox, tool_schemas

#: The protocol's version and its codes of errors.
PROTOCOL = "2024-11-05"
UNKNOWN_METHOD, BAD_MESSAGE = -32601, -32700


def respond(message: dict, box: ToolBox, name: str = "headway") -> dict | None:
    """The answer to one message; none to a notification."""
    method, given = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": name, "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": t["name"], "description": t["description"], "inputSchema": t["input_schema"]} for t in tool_schemas(box.lines)]}
    elif method == "tools/call":
        text, failed = box.call(given.get("name", ""), given.get("arguments") or {})
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": UNKNOWN_METHOD, "message": f"no method {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(box: ToolBox, lines: Iterable[str] | None = None, out: IO[str] | None = None) -> None:
    """Answers every line until there are none; a line that is no message is answered with an error."""
    out = out or sys.stdout
    for line in lines if lines is not None else sys.stdin:
        if not line.strip():
            continue
        try:
            answer = respond(json.loads(line), box)
        except (json.JSONDecodeError, AttributeError) as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_MESSAGE, "message": str(e)}}
        if answer is not None:
            print(json.dumps(answer), file=out, flush=True)
