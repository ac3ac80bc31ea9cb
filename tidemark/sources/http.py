"""HTTP for tasks: connections that stay open, and JSON collections read item by item."""

from __future__ import annotations

import codecs
import http.client
import json
import re
import ssl
import urllib.error
import urllib.parse
from collections.abc import Callable, Iterator

#: Bytes that are read from a response at a time.
CHUNK = 1 << 16
_GAP = re.compile(r"[ \t\r\n]*")


def headers(key: str | None) -> dict[str, str]:
    out = {"Content-Type": "application/json", "Accept": "application/json"}
    return out | ({"Authorization": f"Bearer {key}"} if key else {})


class Session:
    """Requests to one system over one connection, which stays open between them.

    A connection that the server has closed meanwhile is opened again, once for each request; only requests that may
    be repeated (all but POST, and POST with an Idempotency-Key) are sent again when the answer did not come.
    """

    def __init__(self, base: str, key: str | None = None, timeout: float = 10, verify: bool = True):
        self.base, self.key, self.timeout = urllib.parse.urlsplit(base.rstrip("/")), key, timeout
        self.context = None if verify else ssl._create_unverified_context()  # noqa: S323  what the deployment's settings ask for
        self.opened, self._open = 0, None

    def _connection(self) -> http.client.HTTPConnection:
        if self._open is None:
            kind = http.client.HTTPSConnection if self.base.scheme == "https" else http.client.HTTPConnection
            more = {"context": self.context} if self.base.scheme == "https" and self.context else {}
            self._open, self.opened = kind(self.base.hostname, self.base.port, timeout=self.timeout, **more), self.opened + 1
        return self._open

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
            self._open = None

    def send(self, method: str, path: str, body: str | None = None, more: dict[str, str] | None = None) -> http.client.HTTPResponse:
        """The response, whose body is to be read before the next request; HTTP errors raise."""
        again = method != "POST" or "Idempotency-Key" in (more or {})
        for last in (not again, True):
            fresh = self._open is None
            try:
                connection = self._connection()
                connection.request(method, self.base.path + path, body.encode() if body is not None else None, headers(self.key) | (more or {}))
                response = connection.getresponse()
                break
            except (http.client.RemoteDisconnected, http.client.CannotSendRequest, BrokenPipeError, ConnectionResetError):
                self.close()
                if last or fresh:
                    raise
        if response.status >= 400:
            url, text = self.base.geturl() + path, response.read()
            raise urllib.error.HTTPError(url, response.status, response.reason or text.decode(errors="replace")[:200], response.headers, None)
        return response

    def text(self, method: str, path: str, body: str | None = None, more: dict[str, str] | None = None) -> str:
        return self.send(method, path, body, more).read().decode()


class Reader:
    """JSON text that comes in chunks, of which only what is not parsed yet is kept."""

    def __init__(self, read: Callable[[int], bytes], chunk: int = CHUNK):
        self._read, self._chunk = read, chunk
        self._decode, self._json = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder()
        self.text, self.at, self.over = "", 0, False

    def _more(self, least: int = 1) -> bool:
        """Read until there are so many more characters, or the end."""
        parts, got = [self.text[self.at :]], 0
        while got < least and not self.over:
            data = self._read(self._chunk)
            self.over = not data
            parts.append(self._decode.decode(data, final=self.over))
            got += len(parts[-1])
        self.text, self.at = "".join(parts), 0
        return got > 0

    def peek(self) -> str:
        """The next character that is no white space; '' at the end."""
        while True:
            self.at = _GAP.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self._more():
                return ""

    def take(self, expected: str) -> str:
        """The next character, which must be one of these."""
        found = self.peek()
        if not found or found not in expected:
            raise ValueError(f"response is no JSON: {found or 'its end'} where one of {expected} was expected")
        self.at += 1
        return found

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                found, end = self._json.raw_decode(self.text, self.at)
                if end < len(self.text) or self.over:  # a number may go on behind the chunk
                    text, self.at = self.text[self.at : end], end
                    return found, text
            except ValueError:
                if self.over:
                    raise ValueError("response is no JSON, or ends in the middle of a value") from None
            self._more(max(1, len(self.text) - self.at))  # twice as much, so that a long value is not parsed too often

    def listed(self) -> Iterator[str]:
        """The texts of the items of an array."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()[1]
            if self.take(",]") == "]":
                return


def _enveloped(json_: Reader) -> Iterator[str]:
    """The texts of the items of an object's array `data`."""
    json_.take("{")
    if json_.peek() == "}":
        json_.at += 1
        return
    found = False
    while True:
        name, _ = json_.value()
        json_.take(":")
        if name != "data":
            json_.value()
        elif json_.peek() != "[":
            raise ValueError("response object whose data is no array")
        else:
            found = True
            yield from json_.listed()
        if json_.take(",}") == "}":
            break
    if not found:
        raise ValueError("response object without data")


def items(read: Callable[[int], bytes], chunk: int = CHUNK) -> Iterator[str]:
    """The texts of a collection's items, one after another: of an array, or of the array `data` of an object.

    The empty object has none. An object without data, or whose data is no array, is an error; so is what is no JSON.
    Only one item, and a chunk of what follows, is held at a time.
    """
    json_ = Reader(read, chunk)
    yield from json_.listed() if json_.peek() == "[" else _enveloped(json_)
    if json_.peek():
        raise ValueError("response is no JSON: more behind its end")
