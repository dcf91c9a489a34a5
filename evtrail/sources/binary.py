"""Prefetch files and registry hives (survey A11-A13, A19, K18). Formats are read with bounds; a fault is an error row."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

#: Bounds on what a file may claim, and layouts of the two formats.
MOST_METRICS, MOST_NAMES, MOST_VOLUMES = 100_000, 10 * 1024 * 1024, 256
MOST_CELLS, MOST_DEPTH, MOST_VALUE = 100_000, 64, 4 * 1024 * 1024
VERSIONS = (23, 26, 30)
VALUE_KINDS = {1: "REG_SZ", 2: "REG_EXPAND_SZ", 3: "REG_BINARY", 4: "REG_DWORD", 5: "REG_DWORD_BE", 7: "REG_MULTI_SZ", 11: "REG_QWORD"}
RUN_PATHS = tuple("Software\\Microsoft\\Windows\\CurrentVersion\\" + x for x in ("Run", "RunOnce", "Policies\\Explorer\\Run"))
SERVICE_PATHS = ("SYSTEM\\CurrentControlSet\\Services", "ControlSet001\\Services", "ControlSet002\\Services")


class Malformed(ValueError):
    pass


def filetime(n: int) -> str | None:
    """ISO text of whole seconds; None for zero and for years past 3000."""
    seconds = n // 10_000_000 - 11_644_473_600
    if n <= 0 or seconds >= 32_535_216_000:
        return None
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _at(data: bytes, form: str, at: int) -> Any:
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise Malformed(f"offset {at} is outside the file")
    return struct.unpack_from(form, data, at)[0]


def _wide(data: bytes) -> str:
    return data.decode("utf-16-le", "replace").partition("\0")[0]


def prefetch(data: bytes) -> dict[str, Any]:
    """executable, hash, version, runs, last_runs, files, volumes."""
    if data[:4] == b"MAM\x04":
        raise Malformed("compressed prefetch: decompress it first")
    if len(data) < 84 or data[4:8] != b"SCCA":
        raise Malformed("not a prefetch file")
    version = _at(data, "<I", 0)
    if version not in VERSIONS:
        raise Malformed(f"prefetch version {version} isn't supported")
    metrics, n_metrics = _at(data, "<I", 84), _at(data, "<I", 88)
    names, n_names = _at(data, "<I", 100), _at(data, "<I", 104)
    volumes, n_volumes = _at(data, "<I", 108), _at(data, "<I", 112)
    if n_metrics > MOST_METRICS or n_names > MOST_NAMES or n_volumes > MOST_VOLUMES:
        raise Malformed("a section is larger than its bound")
    if names + n_names > len(data):
        raise Malformed("file names reach past the end")
    count = 84 + (68 if version == 23 else 116 if version == 30 and metrics == 0x128 else 124)
    times = [_at(data, "<Q", 84 + 44 + 8 * i) for i in range(1 if version == 23 else 8)]
    size = 96 if version == 30 else 104
    found = []
    for i in range(n_volumes):
        at = volumes + i * size
        path, length = _at(data, "<I", at), _at(data, "<I", at + 4)
        found.append(_wide(data[volumes + path : volumes + path + 2 * length]))
    return {
        "executable": _wide(data[16:76]),
        "hash": f"{_at(data, '<I', 76):08X}",
        "version": version,
        "runs": _at(data, "<I", count),
        "last_runs": [t for t in map(filetime, times) if t],
        "files": [x for x in data[names : names + n_names].decode("utf-16-le", "replace").split("\0") if x],
        "volumes": found,
    }


class Hive:
    """A registry hive's keys and values."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 4096 or data[:4] != b"regf":
            raise Malformed("not a registry hive")
        self.data, self.cells = data, 0
        self.root = self._cell(_at(data, "<I", 0x24))
        if data[self.root : self.root + 2] != b"nk":
            raise Malformed("the root cell isn't a key")

    def _cell(self, offset: int) -> int:
        self.cells += 1
        if self.cells > MOST_CELLS:
            raise Malformed("more cells than the bound")
        at = 4096 + offset
        if _at(self.data, "<i", at) >= 0:
            raise Malformed("a free cell is in use")
        return at + 4

    def _text(self, at: int, size: int, ascii_: bool) -> str:
        body = self.data[at : at + size]
        return body.decode("latin-1") if ascii_ else body.decode("utf-16-le", "replace")

    def name(self, key: int) -> str:
        return self._text(key + 76, _at(self.data, "<H", key + 72), bool(_at(self.data, "<H", key + 2) & 0x20))

    def written(self, key: int) -> str | None:
        return filetime(_at(self.data, "<Q", key + 4))

    def _list(self, offset: int, depth: int = 0) -> Iterator[int]:
        if depth > MOST_DEPTH:
            raise Malformed("key lists are nested too deep")
        at = self._cell(offset)
        kind, n = self.data[at : at + 2], _at(self.data, "<H", at + 2)
        if kind in (b"lf", b"lh"):
            for i in range(n):
                yield self._cell(_at(self.data, "<I", at + 4 + 8 * i))
        elif kind in (b"li", b"ri"):
            for i in range(n):
                below = _at(self.data, "<I", at + 4 + 4 * i)
                if kind == b"li":
                    yield self._cell(below)
                else:
                    yield from self._list(below, depth + 1)
        else:
            raise Malformed("an unknown key list")

    def subkeys(self, key: int) -> list[int]:
        if not _at(self.data, "<I", key + 20):
            return []
        return sorted((k for k in self._list(_at(self.data, "<I", key + 28)) if self.data[k : k + 2] == b"nk"), key=lambda k: self.name(k).lower())

    def values(self, key: int) -> list[tuple[str, str, Any]]:
        """(name, kind, data); an unnamed value is (Default)."""
        n = _at(self.data, "<I", key + 36)
        if not n:
            return []
        at, out = self._cell(_at(self.data, "<I", key + 40)), []
        for i in range(min(n, MOST_CELLS)):
            v = self._cell(_at(self.data, "<I", at + 4 * i))
            if self.data[v : v + 2] != b"vk":
                continue
            size, body = _at(self.data, "<H", v + 2), _at(self.data, "<I", v + 4)
            kind, flags = _at(self.data, "<I", v + 12), _at(self.data, "<H", v + 16)
            length = body & 0x7FFFFFFF
            if length > MOST_VALUE:
                raise Malformed("a value is larger than the bound")
            if body & 0x80000000:
                raw = self.data[v + 8 : v + 8 + min(length, 4)]
            else:
                where = self._cell(_at(self.data, "<I", v + 8)) if length else 0
                raw = self.data[where : where + length]
            wide = not flags & 1 and size >= 2 and size % 2 == 0 and b"\0" in self.data[v + 20 : v + 20 + size]
            out.append((self._text(v + 20, size, not wide) or "(Default)", VALUE_KINDS.get(kind, f"REG_{kind}"), decoded(kind, raw)))
        return out

    def place(self, path: str) -> tuple[int, str] | None:
        """A key by its path, whatever the case, and the path as the hive spells it."""
        key, spelled = self.root, []
        for part in filter(None, path.replace("/", "\\").split("\\")):
            key = next((k for k in self.subkeys(key) if self.name(k).lower() == part.lower()), -1)
            if key < 0:
                return None
            spelled.append(self.name(key))
        return key, "\\".join(spelled)

    def find(self, path: str) -> int | None:
        at = self.place(path)
        return None if at is None else at[0]

    def keys(self, key: int, name: str = "", depth: int = MOST_DEPTH) -> Iterator[tuple[int, str]]:
        """(key, path) of a key and of those below it, depth levels down."""
        stack = [(key, name, depth)]
        while stack:
            key, name, left = stack.pop()
            yield key, name
            if left > 0:
                stack += [(k, f"{name}\\{self.name(k)}".lstrip("\\"), left - 1) for k in reversed(self.subkeys(key))]

    def walk(self, path: str = "") -> Iterator[tuple[str, str | None, str, str, Any]]:
        """(key path, last write, value, kind, data) of a key and all below it."""
        key = self.find(path)
        for at, name in self.keys(key, path) if key is not None else []:
            for value, kind, data in self.values(at):
                yield name, self.written(at), value, kind, data


def decoded(kind: int, raw: bytes) -> Any:
    if kind in (1, 2):
        return _wide(raw)
    if kind == 7:
        return [x for x in raw.decode("utf-16-le", "replace").split("\0") if x]
    if kind in (4, 5) and len(raw) >= 4:
        return int.from_bytes(raw[:4], "little" if kind == 4 else "big")
    if kind == 11 and len(raw) >= 8:
        return int.from_bytes(raw[:8], "little")
    return raw.hex()


def hive_of(tree: dict[str, dict[str, Any]], written: int = 133_500_000_000_000_000) -> bytes:
    """A hive of keys {name: {"values": {name: (kind, bytes)}, "keys": {...}}} below its root, as small as may be; written: their FILETIME."""
    cells = bytearray(32)

    def cell(content: bytes) -> int:
        at, size = len(cells), -(-(len(content) + 4) // 8) * 8
        cells.extend(struct.pack("<i", -size) + content.ljust(size - 4, b"\0"))
        return at

    def value(name: str, kind: int, data: bytes) -> int:
        inside = len(data) <= 4
        where = int.from_bytes(data, "little") if inside else cell(data)
        return cell(b"vk" + struct.pack("<HIIIHH", len(name), len(data) | (inside << 31), where, kind, 1, 0) + name.encode("latin-1"))

    def key(name: str, node: dict[str, Any]) -> int:
        below = {n: key(n, k) for n, k in node.get("keys", {}).items()}
        values = [value(n, *v) for n, v in node.get("values", {}).items()]
        none = 0xFFFFFFFF
        keys_at = cell(struct.pack("<2sH", b"lf", len(below)) + b"".join(struct.pack("<I4s", at, n[:4].encode("latin-1")) for n, at in below.items())) if below else none
        values_at = cell(struct.pack(f"<{len(values)}I", *values)) if values else none
        place = (0, 0, len(below), 0, keys_at, none, len(values), values_at)
        return cell(struct.pack("<2sHQ8I", b"nk", 0x20, written, *place) + bytes(28) + struct.pack("<HH", len(name), 0) + name.encode("latin-1"))

    root = key("ROOT", {"keys": tree})
    head = struct.pack("<4s32xI", b"regf", root).ljust(4096, b"\0")
    return head + bytes(cells)


def list_key(data: bytes, path: str) -> dict[str, Any]:
    """Subkeys and values at a path; KeyError where there is none."""
    hive = Hive(data)
    key = hive.find(path)
    if key is None:
        raise KeyError(path)
    return {"path": path, "last_write": hive.written(key), "subkeys": [hive.name(k) for k in hive.subkeys(key)], "values": hive.values(key)}
