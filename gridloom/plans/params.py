"""Transform parameters: text of the form 'object:name = value[, value ...];' and where a value is looked up."""

from __future__ import annotations

import re
from pathlib import Path


class Params:
    """Parameters by object and name, with a parent to fall back on."""

    def __init__(self, parent: Params | None = None):
        self.values: dict[tuple[str, str], list[str]] = {}
        self.parent = parent

    def set(self, obj: str, name: str, *values) -> None:
        self.values[obj, name] = [str(v) for v in values]

    def get(self, obj: str, name: str, kind=str, default=None):
        """The value, or a list if there are several."""
        found = self.values.get((obj, name))
        if found is None:
            return self.parent.get(obj, name, kind, default) if self.parent else default
        out = [kind(v) for v in found]
        return out[0] if len(out) == 1 else out

    def for_dimension(self, obj: str, dim: str, name: str, kind=str, default=None):
        """Looked up as object:dim:name, then object:name, then dim:name."""
        for place in (f"{obj}:{dim}", obj, dim):
            found = self.get(place, name, kind)
            if found is not None:
                return found
        return default

    def copy(self) -> Params:
        other = Params(self.parent)
        other.values = {k: list(v) for k, v in self.values.items()}
        return other

    def __str__(self) -> str:
        return "".join(f"{obj}:{name} = {', '.join(v)};\n" for (obj, name), v in sorted(self.values.items()))


def parse(text: str, parent: Params | None = None) -> Params:
    out = Params(parent)
    bare = re.sub(r"#[^\n]*", "", text)
    for statement in bare.split(";"):
        if not statement.strip():
            continue
        head, equals, rest = statement.partition("=")
        obj, colon, name = head.strip().rpartition(":")
        if not equals or not colon:
            raise ValueError(f"{statement.strip()!r} is no 'object:name = value'")
        out.set(obj.strip(), name.strip(), *[v.strip().strip("\"'") for v in rest.replace("\n", " ").split(",") if v.strip()])
    return out


def find_file(folders: list[str], site: str, facility: str, name: str, level: str) -> Path | None:
    """The most specific file there is: site, name and facility, then site and name, then name and level, then the name."""
    for folder in folders:
        for file in (f"{site}{name}{facility}.{level}", f"{site}{name}.{level}", f"{name}.{level}", name):
            if (Path(folder) / file).is_file():
                return Path(folder) / file
    return None


def dimension_groups(text: str) -> list[tuple[str, list[str]]]:
    """'{time}, {station:lat,lon}, {height}' as (input dimension, output dimensions)."""
    out = []
    for part in re.findall(r"\{([^}]*)\}", text):
        source, _, targets = part.partition(":")
        out.append((source.strip(), [t.strip() for t in targets.split(",") if t.strip()] or [source.strip()]))
    return out
