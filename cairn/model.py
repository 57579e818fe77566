"""Schemas of the engine's tables and the small languages of its settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

_CHUNK = T.StructType([T.StructField("hash", T.StringType()), T.StructField("len", T.LongType())])
ENTRIES = T.StructType(
    [
        T.StructField("snapshot", T.StringType()), T.StructField("path", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("depth", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mode", T.LongType()),
        T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("symlink_target", T.StringType()),
        T.StructField("xattrs", T.MapType(T.StringType(), T.BinaryType())), T.StructField("device", T.StructType([T.StructField("major", T.LongType()), T.StructField("minor", T.LongType())])),
    ]
)
CHUNK_REFS = "snapshot string, path string, ord int, hash string, len bigint"
#: A stored chunk says by itself how it is read: codec and key of its data, and what its name is a hash by.
CHUNKS = "hash string, len bigint, mode string, bundle_no bigint, chunk_no bigint, attempt string, codec string, hash_method string, key string, data binary"
#: What bundles say of themselves, written with their chunks; what the chunks say is held against it.
BUNDLES = "bundle_no bigint, mode string, attempt string, raw_size bigint, encoded_size bigint, chunk_count bigint, bundle_id string, codec string, hash_method string, key string"
SNAPSHOTS = "snapshot string, attempt string, ts timestamp, host string, path string, config string, total_size bigint, changed_size bigint, dedup_size bigint, encoded_size bigint, bundle_count bigint, chunk_count bigint, avg_chunk_size double, dir_count bigint, file_count bigint, modified boolean, user_names map<bigint,string>, group_names map<bigint,string>"
FILE_TYPES = ("file", "directory", "symlink", "block_device", "char_device", "named_pipe")

# Names, aliases and defaults of the settings.
CHUNKERS = ("ae", "rabin", "fastcdc", "fixed")
CODECS = {"deflate": "deflate", "zlib": "deflate", "gzip": "deflate", "brotli": "brotli", "lzma": "lzma", "lzma2": "lzma", "xz": "lzma", "lz4": "lz4"}
LEVELS = {"deflate": (1, 9), "brotli": (1, 11), "lzma": (1, 9), "lz4": (1, 14)}
DEFAULT_LEVEL, DEFAULT_CHUNK_KIB = 5, 8
SIZE_UNITS = {"b": 0, "k": 1, "m": 2, "g": 3, "t": 4}


class SettingError(ValueError):
    """A setting that can't be read."""


def _name_number(text: str, known, default: int, what: str) -> tuple[str, int]:
    name, slash, number = text.strip().partition("/")
    if name.lower() not in known:
        raise SettingError(f"unknown {what} {name!r}")
    if slash and not number.isdigit():
        raise SettingError(f"{what} {text!r}: {number!r} is not a number")
    return name.lower(), int(number) if slash else default


@dataclass(frozen=True)
class Chunker:
    """A chunker by method and average size in bytes; written as ``name/KiB``."""

    method: str
    size: int
    seed: int = 0

    @classmethod
    def parse(cls, text: str, seed: int = 0) -> Chunker:
        name, kib = _name_number(text, CHUNKERS, DEFAULT_CHUNK_KIB, "chunker")
        return cls(name, kib * 1024, seed)

    def __str__(self) -> str:
        return f"{self.method}/{self.size // 1024}"


@dataclass(frozen=True)
class Compression:
    """A codec and its level, written as ``name/level``; ``none`` is no Compression."""

    method: str
    level: int

    @classmethod
    def parse(cls, text: str) -> Compression | None:
        if text.strip().lower() == "none":
            return None
        name, level = _name_number(text, CODECS, DEFAULT_LEVEL, "compression")
        low, high = LEVELS[CODECS[name]]
        if not low <= level <= high:
            raise SettingError(f"level of {name} is {low} to {high}")
        return cls(CODECS[name], level)

    def __str__(self) -> str:
        return f"{self.method}/{self.level}"


@dataclass(frozen=True)
class Config:
    bundle_size: int = 25 * 1024 * 1024
    chunker: Chunker = field(default_factory=lambda: Chunker.parse("fastcdc/16"))
    compression: Compression | None = field(default_factory=lambda: Compression.parse("brotli/3"))
    hash: str = "blake2"
    #: The name of the key that new data is encrypted with.
    encryption: str | None = None


def parse_size(text: str) -> int:
    """A size in bytes; the suffix b, k, m, g or t is mandatory, but for the empty text."""
    if not text:
        raise SettingError("a size needs a number")
    number, unit = text[:-1], text[-1].lower()
    if unit not in SIZE_UNITS:
        raise SettingError(f"unknown suffix in {text!r}")
    if not re.fullmatch(r"[0-9]+", number):
        raise SettingError(f"{number!r} is not a number")
    return int(number) * 1024 ** SIZE_UNITS[unit]


def parse_repo_path(text: str) -> tuple[str, str | None, str | None]:
    """(repository, snapshot, subpath) of ``repo::snapshot::subpath``; an empty part is unset, an empty repository the default one."""
    parts = (text.split("::", 2) + ["", ""])[:3]
    return parts[0] or "default", parts[1] or None, parts[2] or None


def parse_hex(text: str) -> bytes:
    """Bytes of hex digits; white space between them is passed over."""
    digits = "".join(text.split())
    if len(digits) % 2 or not re.fullmatch(r"[0-9a-fA-F]*", digits):
        raise SettingError(f"{text!r} is not hex")
    return bytes.fromhex(digits)


def encode_chunk_list(chunks: list[tuple[str, int]]) -> bytes:
    """Twenty bytes a chunk: the digest's two halves and the length, each little-endian."""
    out = bytearray()
    for digest, length in chunks:
        raw = bytes.fromhex(digest)
        out += raw[7::-1] + raw[:7:-1] + length.to_bytes(4, "little")
    return bytes(out)


def decode_chunk_list(data: bytes) -> list[tuple[str, int]]:
    if len(data) % 20:
        raise SettingError("a chunk list has 20 bytes a chunk")
    parts = (data[i : i + 20] for i in range(0, len(data), 20))
    return [((p[7::-1] + p[15:7:-1]).hex(), int.from_bytes(p[16:], "little")) for p in parts]


def pax_record(key: str, value: bytes) -> bytes:
    """A record whose leading decimal length counts itself."""
    body = b" " + key.encode() + b"=" + value + b"\n"
    size = len(body)
    while len(str(size)) + len(body) != size:
        size = len(str(size)) + len(body)
    return str(size).encode() + body
