"""Keys for encrypted contents: made, derived from a password, saved and loaded by the driver."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 200_000
SALT = b"cairn key"


@dataclass(frozen=True)
class Key:
    value: bytes

    @classmethod
    def new(cls) -> Key:
        return cls(os.urandom(32))

    @classmethod
    def from_password(cls, password: str) -> Key:
        """The same key for the same password."""
        return cls(hashlib.pbkdf2_hmac("sha256", password.encode(), SALT, ROUNDS))

    @property
    def name(self) -> str:
        """What tells a key from others without giving it away."""
        return hashlib.blake2b(self.value, digest_size=8).hexdigest()

    def save(self, folder: str) -> str:
        path = os.path.join(folder, f"{self.name}.json")
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            json.dump({"name": self.name, "value": self.value.hex()}, f)
        return path

    @classmethod
    def load(cls, path: str) -> Key:
        with open(path) as f:
            found = json.load(f)
        key = cls(bytes.fromhex(found["value"]))
        if key.name != found["name"]:
            raise ValueError(f"{path} is damaged")
        return key

    def column(self) -> Column:
        return F.lit(self.value)
