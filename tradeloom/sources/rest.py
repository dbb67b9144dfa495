"""Paged REST sources as a Spark data source: a partition for each source, pages fetched one after another.

Transports are plain callables (url, params, headers) -> (status, headers, body); http is the one over the network.
"""

from __future__ import annotations

import base64
import importlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import parse_qsl, urlencode, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codes import parse_checkpoint
from ..functions.textnorm import Number, decode_json, look_up, scalar_text

MAX_BODY = 16 << 20
Transport = Callable[[str, dict, dict], tuple[int, dict, bytes]]


class SourceError(RuntimeError):
    """kind: auth, rate_limited, unavailable or contract."""

    def __init__(self, kind: str, detail: str) -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


def check_status(status: int) -> None:
    kind = "auth" if status in (401, 403) else "rate_limited" if status == 429 else "unavailable" if status >= 500 else None if 200 <= status < 300 else "contract"
    if kind:
        raise SourceError(kind, f"status {status}")


def secret(reference: str) -> str:
    """The value of env:NAME; unset or empty is an error."""
    value = os.environ.get(reference.removeprefix("env:"), "") if reference.startswith("env:") else ""
    if not value:
        raise SourceError("auth", "secret isn't set")
    return value


def authorised(kind: str, params: dict, headers: dict, name: str = "", value: str = "") -> tuple[dict, dict]:
    """params and headers with credentials: none, bearer, header, query or basic (value user:password)."""
    match kind:
        case "bearer":
            headers = headers | {"Authorization": f"Bearer {value}"}
        case "header":
            headers = headers | {name: value}
        case "query":
            params = params | {name: value}
        case "basic":
            headers = headers | {"Authorization": "Basic " + base64.b64encode(value.encode()).decode()}
    return params, headers


def _text(value: object) -> str:
    """Compact JSON with sorted keys; numbers as they came."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_text, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _elements(text: str) -> list[str]:
    """The elements of a JSON array, as they stand in the text."""
    decoder, out, at = json.JSONDecoder(), [], text.index("[") + 1
    while True:
        at = len(text) - len(text[at:].lstrip(" \t\r\n,"))
        if text[at] == "]":
            return out
        _, end = decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = end


def records_of(body: bytes, path: str) -> list[str]:
    """The objects of the array at path, each as JSON text. At the root ('' or '.') an object keeps its text; below it is written anew, with sorted keys
    and numbers as they came."""
    if len(body) > MAX_BODY:
        raise SourceError("unavailable", "body too large")
    try:
        text = body.decode("utf-8")
        root = decode_json(text)
    except (ValueError, RecursionError):
        raise SourceError("contract", "no JSON") from None
    found = root if path in ("", ".") else look_up(root, path)
    if found is None:
        raise SourceError("contract", f"nothing at {path}")
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise SourceError("contract", f"no list of objects at {path}")
    return _elements(text) if path in ("", ".") else [_text(x) for x in found]


def next_link(header: str | None) -> dict | None:
    """The parameters of the rel="next" link of a Link header."""
    for part in (header or "").split(","):
        if m := re.search(r'<([^>]*)>\s*;.*rel="?next"?', part):
            return dict(parse_qsl(urlsplit(m[1]).query))
    return None


class TokenBucket:
    """At most `burst` requests at once and `rate` a second; take() gives the seconds to wait."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic) -> None:
        self.rate, self.burst, self.clock, self.held, self.at = rate, burst, clock, float(burst), clock()

    def take(self) -> float:
        now = self.clock()
        self.held = min(self.burst, self.held + (now - self.at) * self.rate) - 1
        self.at = now
        return max(0.0, -self.held / self.rate)


def http(url: str, params: dict, headers: dict, timeout: float = 30.0) -> tuple[int, dict, bytes]:
    """A transport over HTTP: GET, of the body no more than one byte beyond MAX_BODY is read."""
    full = url + (("&" if "?" in url else "?") + urlencode(params) if params else "")
    try:
        with urlopen(Request(full, headers={"Accept": "application/json"} | headers), timeout=timeout) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read(MAX_BODY + 1)
    except HTTPError as e:
        return e.code, dict(e.headers), b""
    except (URLError, TimeoutError, ConnectionError) as e:
        raise SourceError("unavailable", str(e)[:100]) from None


def fetches(transport: Transport, url: str, options: dict) -> Iterator[tuple[list[str], str | None]]:
    """(records, checkpoint of what follows, null at the end) of each page, from the checkpoint in options (page:n or cursor:token) on. pagination: none,
    page, cursor or link; a cursor that comes back as it was sent ends the scan."""
    kind, size = options.get("pagination", "none"), int(options.get("page_size", 100))
    start = parse_checkpoint(options.get("checkpoint"))
    if start and start[0] != kind:
        raise SourceError("contract", f"a {start[0]} checkpoint doesn't fit {kind} pagination")
    at: dict = {"page": start[1] if start else 1, "limit": size} if kind == "page" else {}
    if kind == "page" and at["page"] < 1:
        raise SourceError("contract", "pages count from 1")
    param = options.get("cursor_param", "cursor")
    sent = start[1] if start and kind == "cursor" else None
    if sent:
        at = {param: sent}
    bucket = TokenBucket(float(options.get("rate", 1e9)), int(options.get("burst", 1)))
    while True:
        time.sleep(bucket.take())
        value = secret(options["secret"]) if options.get("secret") else ""
        params, headers = authorised(options.get("auth", "none"), dict(at), {}, options.get("auth_name", ""), value)
        status, head, body = transport(url, params, headers)
        check_status(status)
        found = records_of(body, options.get("records_path", ""))
        following = None
        if kind == "page" and len(found) >= size:
            at = at | {"page": at["page"] + 1}
            following = f"page:{at['page']}"
        elif kind == "cursor":
            token = look_up(decode_json(body.decode("utf-8")), options["cursor_path"])
            token = scalar_text(token) if token is not None else ""
            if token and token != sent:
                sent, at = token, {param: token}
                following = f"cursor:{token}"
        elif kind == "link" and (link := next_link({k.lower(): v for k, v in head.items()}.get("link"))):
            at = at | link
            following = "link:"
        yield found, following
        if following is None:
            return


def pages(transport: Transport, url: str, options: dict) -> Iterator[list[str]]:
    """The records of each page."""
    return (found for found, _ in fetches(transport, url, options))


def sync(transport: Transport, url: str, options: dict, persist: Callable[[list[str], str | None], None]) -> int:
    """Fetch page after page, handing each with the checkpoint of what follows to persist, so that a scan can be taken up where it ended; the
    number of records. A checkpoint that doesn't move on breaks the source's contract."""
    n, before = 0, options.get("checkpoint")
    for found, following in fetches(transport, url, options):
        if following is not None and following == before and following != "link:":
            raise SourceError("contract", f"the checkpoint stays at {following}")
        persist(found, following)
        n, before = n + len(found), following
    return n


def probe(transport: Transport, url: str, options: dict) -> dict:
    """Whether a source answers, whether it lets us in, its first record, and the seconds it took."""
    began = time.monotonic()
    try:
        first = next(pages(transport, url, options))
        told = {"reachable": True, "authenticated": True, "sample": first[0] if first else None}
    except SourceError as e:
        told = {"reachable": e.kind in ("auth", "rate_limited", "contract"), "authenticated": e.kind not in ("auth", "unavailable"), "sample": None}
    return told | {"seconds": time.monotonic() - began}


class _Source(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Source]:
        return [_Source(u) for u in self.options["url"].split() if u]

    def read(self, partition: _Source) -> Iterator[tuple]:
        module, _, name = self.options.get("transport", f"{__name__}:http").rpartition(":")
        transport = getattr(importlib.import_module(module), name)
        for number, found in enumerate(pages(transport, partition.url, self.options)):
            for k, payload in enumerate(found):
                yield partition.url, number, k, payload


class RestSource(DataSource):
    """spark.dataSource.register(RestSource); spark.read.format("paged_rest").options(url=..., transport="module:function", ...)."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "source string, page int, position int, payload string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader({k: v for k, v in self.options.items()})

