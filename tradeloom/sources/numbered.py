"""A transport that serves numbered records page by page, for queries and tests without a network."""

from __future__ import annotations

import json

RECORDS = 230


def transport(url: str, params: dict, headers: dict) -> tuple[int, dict, bytes]:
    """Records 0 to RECORDS - 1 of the source that the URL names, by page and limit, or by cursor."""
    size = int(params.get("limit", 50))
    at = (int(params.get("page", 1)) - 1) * size if "page" in params else int(params.get("cursor", 0))
    rows = [{"id": f"{url}-{k}", "title": f"Record {k}", "n": k} for k in range(at, min(at + size, RECORDS))]
    following = str(at + size) if at + size < RECORDS else None
    return 200, {}, json.dumps({"data": {"items": rows}, "next": following}).encode()
