"""Hashes that have no built-in function, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql.functions import pandas_udf

#: Fixed: the base58 alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@pandas_udf("long")
def blake2b_64(tokens: pd.Series) -> pd.Series:
    """The 64-bit blake2b digest of a text as a signed number; NULL for NULL."""
    return tokens.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), signed=True)).astype("Int64")


@pandas_udf("string")
def base58(data: pd.Series) -> pd.Series:
    """Bytes in base58, leading zero bytes as leading ones."""

    def encode(b: bytes | None) -> str | None:
        if b is None:
            return None
        n, out = int.from_bytes(b), ""
        while n:
            n, k = divmod(n, 58)
            out = BASE58[k] + out
        return "1" * (len(b) - len(b.lstrip(b"\0"))) + out

    return data.map(encode)
