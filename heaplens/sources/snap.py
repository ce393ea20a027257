"""The binary capture format: container, element arrays and sections; and a writer of the same format.

A file is a header, blocks of chunked bytes, index structures and a footer. Entries are arrays of one of
three kinds over a block: a single element, elements of one size, or elements with end offsets.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: signatures and section version.
HEADER, DIRECTORY, FOOTER, SECTION = 0xAEABCDCD, 0xCDCDAEAB, 0xABCDCDAE, 0x20170724
SINGLE, CONSTANT, DYNAMIC = 1, 2, 3
#: Index of each entry that is read.
ENTRIES = {
    "version": 0, "record_date": 1, "user_metadata": 2, "vm": 4, "native_type_name": 5, "object_type": 7, "object_flags": 9, "instance_id": 10, "object_name": 11,
    "object_address": 12, "object_size": 13, "object_root": 14, "handle_target": 15, "edge_from": 16, "edge_to": 17, "heap_start": 18, "heap_bytes": 19, "type_flags": 22,
    "type_name": 23, "type_fields": 25, "type_statics": 26, "type_base": 27, "type_size": 28, "type_info": 29, "field_offset": 31, "field_type": 32, "field_name": 33,
    "field_static": 34, "root_id": 35, "root_area": 36, "root_object": 37, "root_size": 38, "alloc_region": 39, "alloc_root": 40, "alloc_address": 42, "alloc_size": 43,
    "alloc_overhead": 44, "alloc_padding": 45, "region_name": 46, "region_parent": 47, "region_base": 48, "region_size": 49, "region_first": 50, "region_count": 51,
    "object_handle": 58, "target_info": 59, "target_stats": 60, "object_handle_old": 62, "system_address": 83, "system_size": 84, "system_resident": 85, "system_type": 86,
    "system_name": 87, "page_address": 88, "page_first": 89, "page_last": 90, "page_state": 91, "page_size": 92,
}
#: First versions with edges by instance id, target info, heap section kinds, without the old
#: handle entry, with system regions, resident pages, 8-byte ids.
V_EDGES, V_TARGET, V_HEAP_KIND, V_SCENES, V_SYSTEM, V_PAGES, V_WIDE_IDS = 10, 11, 12, 13, 16, 17, 18
#: Bit of a heap section's start that marks the virtual machine's own memory.
VM_BIT = np.uint64(1 << 63)
#: Platform codes.
PLATFORMS = {0: "OSXEditor", 1: "OSXPlayer", 2: "WindowsPlayer", 7: "WindowsEditor", 8: "IPhonePlayer", 11: "Android", 13: "LinuxPlayer", 16: "LinuxEditor", 17: "WebGLPlayer", 25: "PS4", 32: "Switch"}


class CaptureError(ValueError):
    """A file that is not a whole capture."""


class Container:
    """The entries of a capture held in memory."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        size = len(data)
        if size < 16 or self._u("<I", 0) != HEADER or self._u("<I", size - 4) != FOOTER:
            raise CaptureError("header or footer is wrong")
        chapter = self._u("<Q", size - 12)
        if not 0 < chapter < size or self._u("<I", chapter) != DIRECTORY or self._u("<I", chapter + 4) != SECTION:
            raise CaptureError("the chapter directory is wrong")
        blocks = self._u("<Q", chapter + 8)
        self.entries = [int(x) for x in self._many("<i8", chapter + 20, self._u("<i", chapter + 16))]
        if self._u("<I", blocks) != SECTION or self._u("<i", blocks + 4) < 1:
            raise CaptureError("the block section is wrong")
        self.blocks = []
        for at in self._many("<i8", blocks + 8, self._u("<i", blocks + 4)).tolist():
            chunk, total = self._u("<Q", at), self._u("<Q", at + 8)
            if chunk == 0:
                raise CaptureError("a chunk has no size")
            self.blocks.append((chunk, total, self._many("<i8", at + 16, -(-total // chunk)).tolist()))

    def _u(self, form: str, at: int) -> int:
        try:
            return struct.unpack_from(form, self.data, at)[0]
        except struct.error as e:
            raise CaptureError("the file is cut off") from e

    def _many(self, kind: str, at: int, n: int) -> np.ndarray:
        if n < 0 or at + 8 * n > len(self.data):
            raise CaptureError("the file is cut off")
        return np.frombuffer(self.data, kind, n, at)

    def span(self, block: int, start: int, length: int) -> bytes:
        """Bytes of a block, across its chunks."""
        chunk, total, places = self.blocks[block]
        if start < 0 or start + length > total:
            raise CaptureError("a range leaves its block")
        parts = []
        while length > 0:
            within = start % chunk
            take = min(length, chunk - within)
            at = places[start // chunk] + within
            parts.append(bytes(self.data[at : at + take]))
            start, length = start + take, length - take
        return b"".join(parts)

    def _head(self, name: str):
        index = ENTRIES[name]
        at = self.entries[index] if index < len(self.entries) else 0
        return (at, *struct.unpack_from("<HIIQ", self.data, at)) if at else None

    def has(self, name: str) -> bool:
        return self._head(name) is not None

    def count(self, name: str) -> int:
        head = self._head(name)
        return 0 if head is None else {SINGLE: 1, CONSTANT: head[4], DYNAMIC: head[3]}[head[1]]

    def raw(self, name: str) -> list[bytes]:
        """The elements of an entry, [] without it."""
        head = self._head(name)
        if head is None:
            return []
        at, form, block, meta, extra = head
        if form == SINGLE:
            return [self.span(block, extra, meta)]
        if form == CONSTANT:
            whole = self.span(block, 0, meta * extra)
            return [whole[k * meta : (k + 1) * meta] for k in range(extra)]
        if form != DYNAMIC:
            raise CaptureError(f"{name}: format {form}")
        ends = self._many("<i8", at + 18, meta).tolist()
        starts = [extra, *ends[:-1]] if ends else []
        return [self.span(block, s, e - s) for s, e in zip(starts, ends, strict=True)]

    def leading(self, name: str, n: int) -> bytes:
        """The first n bytes of an entry's block, whatever size the entry tells; fewer where the block ends."""
        head = self._head(name)
        if head is None or head[1] == DYNAMIC:
            return b""
        _, form, block, _, extra = head
        start = extra if form == SINGLE else 0
        return self.span(block, start, max(0, min(n, self.blocks[block][1] - start)))

    def array(self, name: str, kind: str, n: int | None = None, default: int | None = None) -> np.ndarray:
        """The numbers of an entry. n: the length it must have; default: what fills a missing one."""
        head, size = self._head(name), np.dtype(kind).itemsize
        if head is None:
            if n is not None and default is None:
                raise CaptureError(f"{name} is missing")
            return np.full(n or 0, default or 0, kind)
        _, form, block, meta, extra = head
        whole = self.span(block, 0, meta * extra) if form == CONSTANT else b"".join(self.raw(name))
        if form == CONSTANT and meta != size and len(whole) % size:
            raise CaptureError(f"{name}: elements of {meta} bytes, not {size}")
        out = np.frombuffer(whole, kind)
        if n is not None and len(out) != n:
            raise CaptureError(f"{name}: {len(out)} elements, not {n}")
        return out

    def strings(self, name: str, n: int | None = None) -> list[str]:
        out = [x.decode("utf-8", "replace") for x in self.raw(name)]
        if n is not None and out and len(out) != n:
            raise CaptureError(f"{name}: {len(out)} elements, not {n}")
        return out or [""] * (n or 0)

    @property
    def version(self) -> int:
        return int(self.array("version", "<u4")[0]) if self.has("version") else 0


def target_stats(c: Container) -> dict | None:
    """What the device reported of its memory: total_virtual and graphics_used bytes; None without it."""
    data = c.leading("target_stats", 40)
    return {"total_virtual": struct.unpack_from("<Q", data, 0)[0], "graphics_used": struct.unpack_from("<Q", data, 32)[0]} if len(data) == 40 else None


def legacy_platform(c: Container) -> str | None:
    """The platform in the user metadata of older formats: a description and a platform, as counted UTF-16 strings."""
    head = c._head("user_metadata")
    data = c.raw("user_metadata")[0] if head is not None and head[1] == SINGLE else b""
    if len(data) < 8:
        return None
    (described,) = struct.unpack_from("<i", data)
    at = 4 + 2 * described
    if described < 0 or at + 4 > len(data):
        return None
    (n,) = struct.unpack_from("<i", data, at)
    if n <= 0 or at + 4 + 2 * n > len(data):
        return "Unknown Platform"
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace")


def target_info(c: Container) -> dict:
    """session_guid, platform, engine_version, product_name of the profile target, {} where there is none."""
    if c.version < V_TARGET:
        return {}
    names = ["target_info", *(n for n in ENTRIES if n != "target_info")]
    for name in names:
        head = c._head(name)
        if head is None or head[1] != SINGLE:
            continue
        data = c.raw(name)[0]
        for at in range(0, len(data) - 511, 4):
            guid, platform = struct.unpack_from("<Ii", data, at)
            (version_n,), (product_n,) = struct.unpack_from("<I", data, at + 48), struct.unpack_from("<I", data, at + 68)
            if 0 < version_n <= 16 and 0 < product_n <= 256:
                version = data[at + 52 : at + 52 + version_n].decode("utf-8", "replace").strip("\0 ")
                product = data[at + 72 : at + 72 + product_n].decode("utf-8", "replace").strip("\0 ")
                known = PLATFORMS.get(platform, f"Platform_{platform}")
                if version and product and (guid or not known.startswith("Platform_")):
                    return {"session_guid": guid, "platform": known, "engine_version": version, "product_name": product}
    return {}


def write(entries: dict[str, tuple[str, object]], chunk: int = 64) -> bytes:
    """A capture of the given entries: name -> (kind, value). kind: `single`, `strings`, `bytes`, or a numpy kind."""
    out, places = bytearray(struct.pack("<I", HEADER)), {}
    payloads, metas = [], {}
    for name, (kind, value) in entries.items():
        if kind == "single":
            metas[name] = (SINGLE, len(payloads), len(value), 0, b"")
            payloads.append(bytes(value))
        elif kind in ("strings", "bytes"):
            parts = [x.encode() if kind == "strings" else bytes(x) for x in value]
            ends = np.cumsum([len(p) for p in parts], dtype="<i8")
            metas[name] = (DYNAMIC, len(payloads), len(parts), 0, ends.tobytes())
            payloads.append(b"".join(parts))
        else:
            a = np.asarray(value, kind)
            metas[name] = (CONSTANT, len(payloads), a.itemsize, len(a), b"")
            payloads.append(a.tobytes())
    payloads = payloads or [b""]
    records = []
    for p in payloads:
        starts = []
        for k in range(0, len(p), chunk):
            starts.append(len(out))
            out += p[k : k + chunk]
        records.append(struct.pack("<QQ", chunk, len(p)) + np.array(starts, "<i8").tobytes())
    block_places = []
    for r in records:
        block_places.append(len(out))
        out += r
    for name, (form, block, meta, extra, tail) in metas.items():
        places[ENTRIES[name]] = len(out)
        out += struct.pack("<HIIQ", form, block, meta, extra) + tail
    section = len(out)
    out += struct.pack("<Ii", SECTION, len(records)) + np.array(block_places, "<i8").tobytes()
    chapter, n = len(out), 93
    out += struct.pack("<IIQi", DIRECTORY, SECTION, section, n) + np.array([places.get(k, 0) for k in range(n)], "<i8").tobytes()
    return bytes(out + struct.pack("<QI", chapter, FOOTER))
