"""Paths on the host that a transcript was written on (FN12, FN13); for the few distinct folders of a batch, on the driver."""

import os
from collections.abc import Callable
from functools import lru_cache
from pathlib import PurePosixPath


def root_of_slug(slug: str, is_folder: Callable[[str], bool] = os.path.isdir) -> str:
    """FN12: the folder that a slug stands for, '' where there is none.

    The first dash is the root. Every other one was a slash, a dot or a dash: from the left, a slash is taken where
    that folder exists, else a dash where that one does, else a slash.
    """
    if not slug.startswith("-") or slug == "-":
        return ""
    names = slug[1:].split("-")
    at = "/" + names[0]
    for name in names[1:]:
        at = next((x for x in (f"{at}/{name}", f"{at}-{name}") if is_folder(x)), f"{at}/{name}")
    return at if is_folder(at) else ""


@lru_cache(maxsize=100_000)
def repository_of(cwd: str, exists: Callable[[str], bool] = os.path.exists) -> str:
    """FN13: the nearest folder from ``cwd`` up that holds '.git' (a folder, or a file in worktrees); ``cwd`` itself where none does."""
    here = PurePosixPath(cwd)
    return next((str(p) for p in (here, *here.parents) if exists(str(p / ".git"))), cwd)
