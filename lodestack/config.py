"""Named catalogs: a TOML file says where each lies, secrets come from the environment only."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from lodestack.functions.values import CatalogError


@dataclass(frozen=True)
class Named:
    """One catalog of a configuration: its folder, where its blobs lie, and where they are kept near."""

    name: str
    root: str
    blobs: str | None = None
    cache: str | None = None

    @property
    def secret(self) -> bytes:
        """The signing secret: ``LODESTACK_SECRET_<NAME>``, else ``LODESTACK_SECRET``."""
        own = f"LODESTACK_SECRET_{self.name.upper().replace('-', '_')}"
        return os.environ.get(own, os.environ.get("LODESTACK_SECRET", "")).encode()


def load_catalogs(path: str) -> dict[str, Named]:
    """The catalogs of a file of tables ``[catalogs.<name>]`` with root, blobs and cache; a secret in it is refused."""
    try:
        with open(path, "rb") as f:
            tree = tomllib.load(f)["catalogs"]
    except (OSError, KeyError, tomllib.TOMLDecodeError) as bad:
        raise CatalogError(f"{path} is no configuration: {bad}") from bad
    out = {}
    for name, said in tree.items():
        if "secret" in said:
            raise CatalogError(f"{name}: a secret belongs into the environment")
        if unknown := set(said) - {"root", "blobs", "cache"}:
            raise CatalogError(f"{name}: what is {sorted(unknown)}?")
        if "root" not in said:
            raise CatalogError(f"{name} has no root")
        out[name] = Named(name, **said)
    return out


def find(path: str, name: str) -> Named:
    held = load_catalogs(path)
    if name not in held:
        raise CatalogError(f"no catalog {name!r}; there are {sorted(held)}")
    return held[name]
