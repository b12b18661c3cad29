"""Signed addresses of blobs: HMAC-SHA256 over checksum and expiry, as the first 32 hexadecimal digits."""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestack.functions.values import CatalogError

_NAME = re.compile(r".*/blob/([0-9a-f]{64})(?:\.[^/.]*)?$")


def sign(secret: bytes, checksum: str, expiry: int) -> str:
    """The signature of a blob until ``expiry``; an empty secret would sign anything and is refused."""
    if not secret:
        raise CatalogError("a signature needs a secret")
    return hmac.new(secret, f"{checksum}:{expiry}".encode(), hashlib.sha256).hexdigest()[:32]


def window_expiry(now: float, lifetime: int) -> int:
    """The end of the lifetime, rounded up to the hour, so that addresses stay the same within one."""
    return math.ceil((now + lifetime) / 3600) * 3600


def verify(secret: bytes, checksum: str, expiry: int, signature: str, now: float) -> bool:
    """Whether the signature is right and its expiry, that second included, is not past."""
    return hmac.compare_digest(sign(secret, checksum, expiry), signature) and expiry >= now


def checksum_from(url: str) -> str | None:
    found = _NAME.match(urlsplit(url).path)
    return found[1] if found else None


def signed_url(base: str, secret: bytes, checksum: Column, ending: Column, expiry: int) -> Column:
    """``<base>/blob/<checksum><ending>?exp=<expiry>&sig=<signature>`` of every row."""
    sign(secret, "", expiry)

    @F.pandas_udf(StringType())
    def signatures(checksums: pd.Series) -> pd.Series:
        return checksums.map(lambda c: None if c is None else sign(secret, c, expiry))

    return F.concat(F.lit(f"{base.rstrip('/')}/blob/"), checksum, ending, F.lit(f"?exp={expiry}&sig="), signatures(checksum))
