"""What callers send to have transcripts indexed (SC11, SC12): payloads checked, as plain values. No server is needed.

A request gives (status, value): 200 and what is to be done, or the status and the reason it was refused.
"""

import json
import os
from collections.abc import Callable

Answer = tuple[int, dict]


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def hook(text: str, resolve: Callable[[str], str] = str) -> dict | None:
    """SC11: what a hook's payload asks to index, None where it asks for nothing.

    Blank and undecodable payloads, those without transcript, session or folder, and those of a stop hook that a stop
    hook called ask for nothing. ``resolve`` turns the folder into the project root.
    """
    payload = _object(text) or {}
    path, session, root = (payload.get(k) or "" for k in ("transcript_path", "session_id", "cwd"))
    root = resolve(root) if root else ""
    if not (path and session and root) or payload.get("stop_hook_active"):
        return None
    return {"transcript_path": path, "session_id": session, "project_root": root}


def index(text: str, project_header: str = "", exists: Callable[[str], bool] = os.path.exists) -> Answer:
    """SC12: a request to index one transcript; the header goes before the folder in the body."""
    body = _object(text)
    if body is None:
        return 400, {"error": "the body is no JSON object"}
    path, session = body.get("transcript_path") or "", body.get("session_id") or ""
    if not path or not session:
        return 400, {"error": "transcript_path and session_id are needed"}
    if not exists(path):
        return 404, {"error": f"no transcript at {path}"}
    root = project_header.strip() or body.get("cwd") or ""
    return (200, {"transcript_path": path, "session_id": session, "project_root": root}) if root else (400, {"error": "a project root is needed"})


def watch(text: str, project_header: str = "") -> Answer:
    """SC12: a request to follow a project."""
    body = _object(text) or {}
    root = project_header.strip() or body.get("project_root") or body.get("cwd") or ""
    return (200, {"project_root": root}) if root else (400, {"error": "a project root is needed"})
