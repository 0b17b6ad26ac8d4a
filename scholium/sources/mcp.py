"""A client of model context servers: JSON-RPC over a transport, capabilities by pages, and many servers at once."""

from __future__ import annotations

import itertools
import json
import subprocess
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from .readers import pages_of

PROTOCOL = "2025-03-26"
Transport = Callable[[dict], dict | None]


class ServerError(RuntimeError):
    """A server that cannot be reached, or that answers with an error."""


@dataclass
class Content:
    kind: str
    text: str = ""
    data: object = None
    mime_type: str = ""
    uri: str = ""


@dataclass
class Result:
    content: list[Content]
    structured: dict | None = None
    is_error: bool = False

    @property
    def text(self) -> str:
        return "\n".join(c.text for c in self.content if c.text)


@dataclass
class Probe:
    server: str
    ok: bool
    info: dict = field(default_factory=dict)
    tools: list[dict] = field(default_factory=list)
    resources: list[dict] = field(default_factory=list)
    prompts: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


class Pipe:
    """A server as a child process, a message a line. What it says without being asked is passed over."""

    def __init__(self, command: str, args: list[str] | None = None, env: Mapping[str, str] | None = None, cwd: str | None = None):
        self.process = subprocess.Popen([command, *(args or [])], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=dict(env) if env else None, cwd=cwd, text=True)

    def __call__(self, message: dict) -> dict | None:
        try:
            self.process.stdin.write(json.dumps(message) + "\n")
            self.process.stdin.flush()
        except OSError as e:
            raise ServerError("the server has ended") from e
        if "id" not in message:
            return None
        for line in self.process.stdout:
            reply = json.loads(line)
            if reply.get("id") == message["id"]:
                return reply
        raise ServerError("the server has ended")

    def close(self) -> None:
        self.process.terminate()
        self.process.wait(timeout=5)


class Post:
    """A server behind a URL. post: (url, body, headers) -> (body, headers of the reply)."""

    def __init__(self, url: str, post: Callable[[str, bytes, dict], tuple[bytes, Mapping[str, str]]], headers: Mapping[str, str] | None = None):
        self.url, self.post, self.headers = url, post, {"Content-Type": "application/json", "Accept": "application/json, text/event-stream", **(headers or {})}

    def __call__(self, message: dict) -> dict | None:
        try:
            body, headers = self.post(self.url, json.dumps(message).encode(), self.headers)
        except OSError as e:
            raise ServerError(str(e)) from e
        if session := {k.lower(): v for k, v in headers.items()}.get("mcp-session-id"):
            self.headers["Mcp-Session-Id"] = session
        text = body.decode().strip()
        events = [line[5:].strip() for line in text.splitlines() if line.startswith("data:")]
        messages = [json.loads(x) for x in events or ([text] if text else [])]
        return next((m for m in messages if m.get("id") == message.get("id")), None)

    def close(self) -> None:
        """Nothing is held."""


class Client:
    """One connection. Used as a context, it opens with a handshake and closes its transport."""

    def __init__(self, transport: Transport):
        self.transport, self.info, self._ids = transport, {}, itertools.count(1)

    def __enter__(self) -> Client:
        self.info = self.request("initialize", {"protocolVersion": PROTOCOL, "capabilities": {}, "clientInfo": {"name": "scholium", "version": "1"}})
        self.transport({"jsonrpc": "2.0", "method": "notifications/initialized"})
        return self

    def __exit__(self, *_: object) -> None:
        if hasattr(self.transport, "close"):
            self.transport.close()

    def request(self, method: str, params: dict | None = None) -> dict:
        reply = self.transport({"jsonrpc": "2.0", "id": next(self._ids), "method": method, "params": params or {}})
        if reply is None or "error" in reply:
            raise ServerError(str((reply or {}).get("error", {}).get("message", "no reply")))
        return reply.get("result") or {}

    def _all(self, method: str, name: str) -> list[dict]:
        def page(cursor: str | None) -> tuple[list, str | None]:
            got = self.request(method, {"cursor": cursor} if cursor else {})
            return got.get(name, []), got.get("nextCursor")

        return pages_of(page)

    def tools(self) -> list[dict]:
        return self._all("tools/list", "tools")

    def resources(self) -> list[dict]:
        return self._all("resources/list", "resources")

    def prompts(self) -> list[dict]:
        return self._all("prompts/list", "prompts")

    def ping(self) -> None:
        self.request("ping")

    def call(self, tool: str, arguments: Mapping[str, object] | None = None) -> Result:
        if not tool.strip():
            raise ValueError("a tool needs a name")
        got = self.request("tools/call", {"name": tool, "arguments": dict(arguments or {})})
        return Result([_content(c) for c in got.get("content", [])], got.get("structuredContent"), bool(got.get("isError")))

    def read(self, uri: str) -> list[Content]:
        if not uri.strip():
            raise ValueError("a resource needs an address")
        got = self.request("resources/read", {"uri": uri}).get("contents", [])
        return [Content("text" if c.get("text") else "blob", c.get("text") or "", c.get("blob"), c.get("mimeType", ""), c.get("uri", "")) for c in got]


def _content(block: dict) -> Content:
    text, data = block.get("text") or "", block.get("data")
    return Content(block.get("type", "unknown"), text, block if data is None and not text else data, block.get("mimeType", ""))


class Servers:
    """Servers by name; each call opens a connection of its own. connect: configuration -> transport."""

    def __init__(self, configurations: list[dict], connect: Callable[[dict], Transport]):
        self.known, self.connect = {c["name"]: c for c in configurations}, connect

    def open(self, name: str) -> Client:
        if name not in self.known:
            raise ServerError(f"there is no server {name}")
        return Client(self.connect(self.known[name]))

    def call(self, name: str, tool: str, arguments: Mapping[str, object] | None = None) -> Result:
        with self.open(name) as client:
            return client.call(tool, arguments)

    def read(self, name: str, uri: str) -> list[Content]:
        with self.open(name) as client:
            return client.read(uri)

    def probe(self, name: str) -> Probe:
        """What a server offers; a list that it cannot give is an error beside the others."""
        out = Probe(name, False)
        try:
            with self.open(name) as client:
                out.ok, out.info = True, client.info
                for kind in ("tools", "resources", "prompts"):
                    try:
                        setattr(out, kind, getattr(client, kind)())
                    except (ServerError, ValueError) as e:
                        out.errors.append(f"{kind}: {e}")
        except (ServerError, OSError, ValueError) as e:
            out.errors.append(str(e))
        return out

    def probe_all(self, workers: int = 8) -> list[Probe]:
        """All servers at once, in the order of their names' registration."""
        with ThreadPoolExecutor(max_workers=workers) as pool:
            return list(pool.map(self.probe, self.known))
