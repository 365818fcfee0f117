"""xxh3 digests of binary columns, and the deterministic stub embedder, over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def xxh3_128(data: Column) -> Column:
    """the 128-bit digest, big-endian."""

    def run(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda b: None if b is None else xxhash.xxh3_128_digest(bytes(b)))

    return F.pandas_udf(run, "binary")(data)


def chunk_id(file_hash: bytes, start: int, end: int) -> int:
    """signed 64 bits of xxh3-64 over the file hash and the big-endian byte range."""
    import xxhash

    v = xxhash.xxh3_64_intdigest(file_hash + start.to_bytes(4, "big") + end.to_bytes(4, "big"))
    return v - (1 << 64) if v >> 63 else v


def stub_vector(text: str, width: int = 8) -> list[float]:
    """Bytes of the text's digest, spread over [-1, 1]."""
    import xxhash

    d = xxhash.xxh3_128_digest(text.encode())
    return [d[i % 16] / 255 * 2 - 1 for i in range(width)]
