"""Sample types: what a catalog knows of a type's bytes and metadata, looked up by the nearest registered ancestor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from lodestack.functions.values import CatalogError, canonical_text, split_type


@dataclass(frozen=True)
class SampleType:
    """One registered type. ``canonical`` maps bytes to the form they are stored in, ``facts`` bytes to metadata; ``keys`` declares the kinds of metadata values.

    A ``generated`` type comes only out of generate runs. A fine-tuning ``example`` names its ``inputs`` among its metadata keys.
    """

    name: str
    canonical: Callable[[bytes], bytes] | None = None
    facts: Callable[[bytes], dict] | None = None
    keys: dict[str, str] = field(default_factory=dict)
    generated: bool = False
    example: bool = False
    inputs: tuple[str, ...] = ()

    def form(self, content: bytes) -> bytes:
        if self.canonical is not None:
            return self.canonical(content)
        return canonical_text(content) if self.name.startswith("text/") else content

    def known(self, content: bytes) -> dict:
        return self.facts(content) if self.facts else {}


class Types:
    """A registry; a type that is not in it is as the nearest one above it, the plain type of its media last."""

    def __init__(self, *types: SampleType) -> None:
        self.held: dict[str, SampleType] = {}
        for t in types or (SampleType("text/plain"), SampleType("text/email"), SampleType("image/plain")):
            self.register(t)

    def register(self, t: SampleType) -> None:
        split_type(t.name)
        self.held[t.name] = t
        kinds: dict[str, str] = {}
        for other in self.held.values():
            for key, kind in other.keys.items():
                if kinds.setdefault(key, kind) != kind:
                    raise CatalogError(f"{key} is declared as {kinds[key]} and as {kind}")

    def nearest(self, name: str) -> SampleType | None:
        media, subtype = split_type(name)
        parts = subtype.split("/")
        for n in range(len(parts), 0, -1):
            if found := self.held.get(f"{media}/{'/'.join(parts[:n])}"):
                return found
        return self.held.get(f"{media}/plain")

    def resolve(self, name: str) -> SampleType:
        """The type above or at a name; of an unknown media a bare one."""
        return self.nearest(name) or SampleType(name)

    def refuse_generated(self, name: str, how: str) -> None:
        if self.resolve(name).generated:
            raise CatalogError(f"{name} is generated; only a generate run writes it, {how} does not")

    def example(self, name: str) -> SampleType | None:
        """The fine-tuning type that a name is, if it is one; below one it has to be registered itself."""
        t = self.resolve(name)
        if t.example and t.name != name:
            raise CatalogError(f"{name} is not registered and lies below the fine-tuning type {t.name}")
        return t if t.example else None

    def declared(self, names: list[str]) -> dict[str, str]:
        """Kinds of the metadata keys that the types at and below the named ones declare."""
        out: dict[str, str] = {}
        for name in names:
            media, subtype = split_type(name)
            for t in self.held.values():
                m, s = split_type(t.name)
                if m == media and (subtype == "plain" or s == subtype or s.startswith(f"{subtype}/")):
                    out |= t.keys
            out |= self.resolve(name).keys
        return out
