"""Paths of rules, data and schemas: dotted (a.b), pointers (/a/b) and schema references (#/properties/a)."""

from __future__ import annotations

import re


def to_pointer(path: str) -> str:
    """A JSON pointer; "" is the root. Dots separate only where no slash or hash leads."""
    if path in ("", "/", "#", "#/"):
        return ""
    if path[0] not in "/#":
        path = "/" + path.replace(".", "/")
    path = re.sub("/{2,}", "/", "/" + path.lstrip("#"))
    return "" if path == "/" else path


def segments(path: str) -> list[str]:
    """Steps of a data lookup: the schema's "properties" steps have no place in data."""
    return [s for s in to_pointer(path).split("/") if s and s != "properties"]


def data_pointer(schema_path: str) -> str:
    """Where in the data the field of a schema path is."""
    return "".join(f"/{s}" for s in segments(schema_path))


def schema_pointer(dotted: str) -> str:
    """Schema reference of a dotted field; paths that start with $ are not nested in properties."""
    if dotted.startswith("#"):
        return dotted
    steps = [s for s in to_pointer(dotted).split("/") if s]
    if not steps:
        return "#"
    if steps[0].startswith("$"):
        return "#/" + "/".join(steps)
    out = [steps[0]]
    for s in steps[1:]:
        out += [s] if s == "properties" or out[-1] == "properties" else ["properties", s]
    return "#/" + "/".join(out)


def dotted(pointer: str) -> str:
    """Dotted name of a schema reference or pointer."""
    return ".".join(segments(pointer))
