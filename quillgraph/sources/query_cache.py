"""Cache of query vectors of one model, with a binary file form.

File: magic, version, dimension, model, count, checksum, then records of a
sha-256 key and little-endian float32 values. A file that doesn't fit in any
way loads nothing and raises nothing.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
import zlib

import numpy as np

MAGIC, VERSION = b"MQEC", 2


class QueryCache:
    def __init__(self, model: str, dim: int | None = None, most: int = 512):
        self.model, self.dim, self.most = model, dim, most
        self.rows: dict[bytes, np.ndarray] = {}

    @staticmethod
    def key(query: str) -> bytes:
        return hashlib.sha256(query.encode("utf-8", "surrogatepass")).digest()

    def __len__(self) -> int:
        return len(self.rows)

    def get(self, query: str) -> list[float] | None:
        got = self.rows.get(self.key(query))
        return None if got is None else got.astype(float).tolist()

    def put(self, query: str, vector) -> None:
        v = np.asarray(vector, np.float32)
        if self.dim is None:
            self.dim = len(v)
        if len(v) == self.dim:
            self._add(self.key(query), v)

    def _add(self, key: bytes, v: np.ndarray) -> None:
        self.rows.pop(key, None)
        while self.rows and len(self.rows) >= self.most:
            del self.rows[next(iter(self.rows))]
        if self.most > 0:
            self.rows[key] = v

    def clear(self) -> None:
        self.rows.clear()

    def reconcile(self, model: str, dim: int) -> None:
        """Empty the cache if the model or the dimension changed."""
        if (model, dim) != (self.model, self.dim):
            self.clear()
        self.model, self.dim = model, dim

    def dump(self, path: str) -> int:
        body = b"".join(k + v.astype("<f4").tobytes() for k, v in self.rows.items())
        model = self.model.encode()
        head = MAGIC + struct.pack("<BIH", VERSION, self.dim or 0, len(model)) + model + struct.pack("<II", len(self.rows), zlib.crc32(body))
        handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(handle, "wb") as f:
            f.write(head + body)
        os.replace(part, path)
        return len(self.rows)

    def load(self, path: str) -> int:
        try:
            with open(path, "rb") as f:
                data = f.read()
            version, dim, n = struct.unpack_from("<BIH", data, 4)
            model = data[11 : 11 + n].decode()
            count, check = struct.unpack_from("<II", data, 11 + n)
        except (OSError, struct.error, UnicodeDecodeError):
            return 0
        body, size = data[19 + n :], 32 + 4 * dim
        fits = data[:4] == MAGIC and version == VERSION and model == self.model and self.dim in (None, dim)
        if not fits or len(body) != count * size or zlib.crc32(body) != check:
            return 0
        self.dim = dim
        for k in range(count):
            row = body[k * size : (k + 1) * size]
            self._add(row[:32], np.frombuffer(row[32:], "<f4"))
        return count
