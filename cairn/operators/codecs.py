"""Compression and encryption of byte columns."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.model import Compression


def compress(data: bytes, codec: Compression | None) -> bytes:
    if codec is None:
        return data
    if codec.method == "deflate":
        return zlib.compress(data, codec.level)
    if codec.method == "lzma":
        return lzma.compress(data, preset=codec.level)
    size = len(data).to_bytes(8, "little")
    level = codec.level if codec.method == "brotli" else min(codec.level, 12)
    return size + pa.Codec(codec.method, compression_level=level).compress(data, asbytes=True)


def decompress(data: bytes, codec: Compression | None) -> bytes:
    if codec is None:
        return data
    if codec.method == "deflate":
        return zlib.decompress(data)
    if codec.method == "lzma":
        return lzma.decompress(data)
    return pa.Codec(codec.method).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _column(function: Callable[[bytes, Compression | None], bytes], codec: Compression | None) -> Callable[[Column], Column]:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: None if v is None else function(bytes(v), codec))

    return run


def compressed(column: Column, codec: Compression | None) -> Column:
    return _column(compress, codec)(column)


def decompressed(column: Column, codec: Compression | None) -> Column:
    return _column(decompress, codec)(column)


def decompressed_by(column: Column, codec: Column) -> Column:
    """Bytes by the codec that each row names; a null codec is none."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Compression | None] = {}
        for values, names in batches:
            for name in names.dropna().unique():
                known[name] = known.get(name) or Compression.parse(name)
            yield pd.Series([None if v is None else decompress(bytes(v), known.get(n)) for v, n in zip(values, names, strict=True)], dtype=object)

    return run(column, codec)


def encrypted(column: Column, key: Column) -> Column:
    """AES-GCM in the JVM; a changed byte or another key fails the decryption."""
    return F.aes_encrypt(column, key, F.lit("GCM"))


def decrypted(column: Column, key: Column) -> Column:
    return F.aes_decrypt(column, key, F.lit("GCM"))


def password_key(password: str) -> Column:
    """A 256-bit key, the same for the same password."""
    return F.unhex(F.sha2(F.lit(password), 256))
