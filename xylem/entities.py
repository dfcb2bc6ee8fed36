"""Named character references, both ways."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ValidationError

STANDARD = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39}
MODES = ("required", "optional", "disabled", "custom")


class EntityRegistry:
    """A two-way map between entity names and code points.

    ``mode``: required and optional hold the HTML 5 names of one character, disabled the five of XML alone, custom what
    ``provider`` returns.
    """

    def __init__(self, mode: str = "optional", provider: Callable[[], dict[str, int]] | None = None):
        if mode not in MODES:
            raise ValidationError(f"unknown entity mode {mode!r}", modes=", ".join(MODES))
        if mode == "custom" and provider is None:
            raise ValidationError("mode custom needs a provider")
        self.mode, self.provider = mode, provider
        self.clear()
        if mode in ("required", "optional"):
            self.register({n[:-1]: ord(c) for n, c in html5.items() if n.endswith(";") and len(c) == 1})
        elif mode == "custom":
            self.register(provider())

    def clear(self) -> None:
        """Back to the five names of XML."""
        self._by_name = dict(STANDARD)
        self._by_point: dict[int, list[str]] = {}
        for n, p in STANDARD.items():
            self._by_point.setdefault(p, []).append(n)

    def register(self, names: dict[str, int]) -> None:
        for n, p in names.items():
            if self._by_name.setdefault(n, p) == p and n not in self._by_point.setdefault(p, []):
                self._by_point[p].append(n)

    def declared(self, name: str) -> bool:
        return name in self._by_name

    def code_point(self, name: str) -> int | None:
        return self._by_name.get(name)

    def names(self, point: int) -> list[str]:
        return list(self._by_point.get(point, ()))

    def primary_name(self, point: int) -> str | None:
        """The name to write: lower-case before others, then the shortest, then the first in order."""
        return min(self._by_point.get(point, ()), key=lambda n: (not n.islower(), len(n), n), default=None)

    def is_standard(self, name: str) -> bool:
        return name in STANDARD

    def restorable(self) -> set[int]:
        """Code points that may be written by name: those beyond ASCII that have one."""
        return {p for p in self._by_point if p > 127} if self.mode != "disabled" else set()

    def should_restore(self, point: int) -> bool:
        return point in self.restorable()

    def restore(self, text: Column, points: list[int]) -> Column:
        """The text with the given code points as named references; those without a name stay."""
        for p in points:
            if self.should_restore(p):
                text = F.replace(text, F.lit(chr(p)), F.lit(f"&{self.primary_name(p)};"))
        return text


ENCODINGS = {"none": "", "basic": "<>&", "quotes": '<>&"', "full": "<>&\"'"}
_NAMES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def encode_entities(text: Column, mode: str = "basic") -> Column:
    """The text with the mode's characters as references: none, basic, quotes or full."""
    if mode not in ENCODINGS:
        raise ValidationError(f"unknown encoding mode {mode!r}")
    for c in "&<>\"'":
        if c in ENCODINGS[mode]:
            text = F.replace(text, F.lit(c), F.lit(_NAMES[c]))
    return text


def decode_entities(text: Column, registry: EntityRegistry | None = None, names: list[str] | None = None) -> Column:
    """The text with named references (the five of XML, or the given) as characters; & last."""
    registry = registry or EntityRegistry("disabled")
    for n in [*(x for x in (names or STANDARD) if x != "amp"), "amp"]:
        if (p := registry.code_point(n)) is not None:
            text = F.replace(text, F.lit(f"&{n};"), F.lit(chr(p)))
    return text
