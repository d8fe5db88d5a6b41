"""128-bit digests that stand for long keys in shuffles."""

from __future__ import annotations

import pandas as pd
import xxhash


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def digests(s: pd.Series) -> pd.Series:
    """Digest of each value, each distinct value once; null stays null."""
    seen: dict[str, bytes] = {}
    return pd.Series([None if x is None else seen.get(x) or seen.setdefault(x, digest(x)) for x in s], dtype=object)
