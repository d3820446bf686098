"""Settings of lines KEY=VALUE, as the driver reads them before a session starts."""

from __future__ import annotations

from collections.abc import Mapping


def parsed(text: str) -> dict[str, str]:
    """Values by key; the first line of a key counts. Blank lines, comments and lines without = are passed over, quotes around
    a value go."""
    found: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        key, equals, value = line.partition("=")
        if equals and not line.startswith("#"):
            found.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return found


def merged(known: Mapping[str, str], text: str) -> dict[str, str]:
    """Settings already known and, for other keys, text's."""
    return parsed(text) | dict(known)


def configured(values: Mapping[str, str], *keys: str) -> bool:
    """Whether all keys have a value; any text counts as one, so does "0" or "false"."""
    return all(values.get(k) for k in keys)
