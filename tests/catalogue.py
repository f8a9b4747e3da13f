"""Transports without a network."""

from __future__ import annotations

import json
import time
import uuid


def catalog_get(url: str, params: dict) -> tuple[int, dict, str]:
    """A catalogue of 60 items whose titles hold the query."""
    total, size = 60, int(next(v for k, v in params.items() if k in ("rows", "limit", "per_page", "p", "max_results", "retmax")))
    first = int(next((v for k, v in params.items() if k in ("start", "offset", "s", "retstart")), 1))
    query = next(str(v) for k, v in params.items() if k in ("q", "query", "search", "term", "search_query"))
    items = [{"id": f"{query}-{i}", "title": f"{query} item {i}", "author": [{"name": f"A{i % 7}"}, {"name": f"B{i % 5}"}]} for i in range(first, min(first + size, total + 1))]
    return 200, {"Content-Type": "application/json"}, json.dumps({"total": total, "items": items})


def logged_get(url: str, params: dict) -> tuple[int, dict, str]:
    """The same; each call leaves a file in the folder that the address names, so that calls of all processes can be counted."""
    with open(f"{url.partition('?')[2]}/{uuid.uuid4().hex}", "w") as out:
        json.dump(params | {"at": time.time()}, out)
    return catalog_get(url, params)
