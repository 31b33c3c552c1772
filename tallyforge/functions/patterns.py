"""Patterns that users have saved: refused before a plan is made if they are too long, can't be read, or may run for ever."""

from __future__ import annotations

import re

LONGEST = 300


def fault(pattern: str, groups: int = 0) -> str | None:
    """Why a pattern is refused, or None. Repeated groups that hold a repetition themselves may take exponential time."""
    if len(pattern) > LONGEST:
        return f"longer than {LONGEST} characters"
    try:
        found = re.compile(pattern)
    except re.error:
        return "not a regular expression"
    if found.groups < groups:
        return f"fewer than {groups} groups"
    if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]", pattern):
        return "a repeated group that repeats inside"
    return None


def checked(pattern: str, groups: int = 0) -> str:
    why = fault(pattern, groups)
    if why:
        raise ValueError(f"pattern refused: {why}")
    return pattern
