"""Envelopes of the service's answers and its machine-readable description."""

from __future__ import annotations

from typing import Any

VERSION = "v1"


def success(data: Any, operation: str, transport: str, status: int = 200) -> dict[str, Any]:
    return {"api_version": VERSION, "ok": True, "transport": transport, "operation": operation, "status_code": status, "data": data}


def error(message: str, operation: str, transport: str, status: int, detail: str | None = None) -> dict[str, Any]:
    what = {"message": message} | ({"detail": detail} if detail else {})
    return {"api_version": VERSION, "ok": False, "transport": transport, "operation": operation, "status_code": status, "error": what}


#: path: (method, operation, {parameter: (type, required, default)})
ROUTES: dict[str, tuple[str, str, dict[str, tuple[str, bool, object]]]] = {
    "/health": ("get", "health", {}),
    "/openapi.json": ("get", "openapi_json", {}),
    "/speaker/brief": ("get", "speaker_brief", {"speaker_name": ("string", True, None), "theme": ("string", False, None)}),
    "/speaker/timeline": ("get", "speaker_timeline", {"speaker_name": ("string", True, None), "limit": ("integer", False, 10)}),
    "/speaker/comparisons": ("get", "speaker_comparisons", {"speaker_name": ("string", True, None), "comparison_type": ("string", False, None), "limit": ("integer", False, 10)}),
    "/speaker/orphaned": ("get", "speaker_orphaned", {"speaker_name": ("string", True, None), "window_days": ("integer", False, 75), "min_emphasis": ("integer", False, 3)}),
    "/speaker/drift": ("get", "speaker_drift", {"speaker_name": ("string", True, None), "theme": ("string", False, None), "window_days": ("integer", False, 730), "limit": ("integer", False, 20)}),
    "/speaker/phrases": ("get", "speaker_phrases", {"speaker_name": ("string", True, None), "limit": ("integer", False, 20), "min_rarity": ("number", False, None)}),
    "/speaker/latest": ("get", "speaker_latest", {"speaker_name": ("string", True, None)}),
    "/speaker/question": ("post", "speaker_question", {"speaker_name": ("string", True, None), "question": ("string", True, None)}),
    "/ingest/url": ("post", "ingest_url", {"url": ("string", True, None), "skip_existing": ("boolean", False, False)}),
    "/ingest/urls": ("post", "ingest_urls", {"urls": ("array", True, None), "skip_existing": ("boolean", False, True)}),
    "/ingest/markdown": ("post", "ingest_markdown", {"markdown_text": ("string", True, None), "metadata": ("object", False, {})}),
}


def openapi() -> dict[str, Any]:
    """The description of all routes (OpenAPI 3.1)."""
    paths: dict[str, Any] = {}
    for path, (method, operation, parameters) in ROUTES.items():
        entry: dict[str, Any] = {"operationId": operation, "summary": operation.replace("_", " ").capitalize()}
        if method == "get" and parameters:
            entry["parameters"] = [
                {"name": n, "in": "query", "required": needed, "schema": {"type": kind} | ({"default": default} if default is not None else {})} for n, (kind, needed, default) in parameters.items()
            ]
        paths[path] = {method: entry}
    info = {"title": "Longitudinal text analytics", "version": VERSION, "description": "Local API over stored text-analysis artifacts."}
    return {"openapi": "3.1.0", "info": info, "servers": [{"url": "http://127.0.0.1:8000"}], "paths": paths}
