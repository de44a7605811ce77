"""A language model behind one of two wire interfaces, as an answers.Client. The transport can be replaced."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

TIMEOUT = 60.0
#: (address, headers, body) -> lines of the reply.
Send = Callable[[str, dict[str, str], bytes], Iterator[bytes]]


def http_lines(url: str, headers: dict[str, str], body: bytes) -> Iterator[bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=TIMEOUT) as reply:
        yield from reply


@dataclass
class WireClient:
    """Chat over HTTP. ``wire`` is 'chat' (a list of messages) or 'responses' (instructions and one text); replies come as a stream of events or whole."""

    url: str
    key: str
    model: str
    wire: str = "chat"
    provider: str = "model"
    stream: bool = True
    temperature: float = 0.0
    send: Send = http_lines
    calls: int = 0

    def request(self, messages: list[dict[str, str]]) -> tuple[str, dict]:
        """The address and the body of a call."""
        body = {"model": self.model, "temperature": self.temperature, "stream": self.stream}
        if self.wire != "responses":
            return f"{self.url.rstrip('/')}/chat/completions", body | {"messages": messages}
        said = [m for m in messages if m.get("content")]
        rules = [m["content"] for m in said if m.get("role") == "system"]
        text = [f"{m.get('role', 'user')}: {m['content']}" for m in said if m.get("role") != "system"]
        return f"{self.url.rstrip('/')}/responses", body | {"input": "\n\n".join(text)} | ({"instructions": "\n\n".join(rules)} if rules else {})

    def chat(self, messages: list[dict[str, str]]) -> Iterator[str]:
        """Pieces of the reply. Whatever goes wrong is a RuntimeError that names the provider."""
        if not self.key:
            raise RuntimeError(f"{self.provider.upper()} API key is not configured.")
        self.calls += 1
        try:
            url, body = self.request(messages)
            lines = self.send(url, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}, json.dumps(body).encode())
            yield from (self._deltas(lines) if self.stream else [self._whole(json.loads(b"".join(lines)))])
        except Exception as error:
            raise RuntimeError(f"{self.provider.upper()} LLM call failed: {error}") from error

    def _deltas(self, lines: Iterator[bytes]) -> Iterator[str]:
        for line in lines:
            data = line.strip().removeprefix(b"data:").strip()
            if not line.startswith(b"data:") or data == b"[DONE]":
                continue
            event = json.loads(data)
            if self.wire == "responses":
                piece = event.get("delta") if event.get("type") == "response.output_text.delta" else None
            else:
                piece = (event.get("choices") or [{}])[0].get("delta", {}).get("content")
            if piece:
                yield piece

    def _whole(self, reply: dict) -> str:
        if self.wire != "responses":
            return reply["choices"][0]["message"].get("content") or ""
        parts = [c.get("text") or "" for item in reply.get("output") or [] for c in item.get("content") or []]
        return reply.get("output_text") or "".join(parts)
