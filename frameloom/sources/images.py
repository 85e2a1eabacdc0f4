"""Image formats in numpy: PNG of 8 or 16 bits, scan-line EXR, and numpy archives.

Signatures, attribute names and codes are fixed by the formats' definitions.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_EXR = 20000630
_TYPES = {0: "<u4", 1: "<f2", 2: "<f4"}


def encode_png(a: np.ndarray) -> bytes:
    """A (h, w) or (h, w, 3) array of uint8 or uint16."""
    a = a if a.ndim == 3 else a[:, :, None]
    depth = a.dtype.itemsize * 8
    rows = a.astype(">u2" if depth == 16 else np.uint8).reshape(len(a), -1).view(np.uint8)
    data = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">2I5B", a.shape[1], a.shape[0], depth, {1: 0, 3: 2}[a.shape[2]], 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def decode_png(content: bytes) -> np.ndarray:
    """(h, w) or (h, w, channels) of uint8 or uint16; interlaced and palette files are refused."""
    if not content.startswith(_PNG):
        raise ValueError("not a PNG file")
    at, data = len(_PNG), b""
    while at < len(content):
        (size,) = struct.unpack_from(">I", content, at)
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">2I5B", body)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    if interlaced or depth not in (8, 16) or colour not in _CHANNELS:
        raise ValueError("this kind of PNG is not read")
    step = _CHANNELS[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w + 1, step), np.int64)  # a row and a pixel of zeros before the image
    for y in range(h):
        line, mode = rows[y, 1:].reshape(w, step).astype(np.int64), rows[y, 0]
        if mode == 0:
            out[y + 1, 1:] = line
        elif mode == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        elif mode == 2:
            out[y + 1, 1:] = (line + out[y, 1:]) & 255
        else:
            for x in range(w):
                left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.choose(near.argmin(axis=0), [left, up, corner])
                out[y + 1, x + 1] = (line[x] + guess) & 255
    raw = out[1:, 1:].astype(np.uint8)
    a = raw if depth == 8 else np.ascontiguousarray(raw).view(">u2").astype(np.uint16)
    return a[:, :, 0] if a.shape[2] == 1 else a


def unit_image(a: np.ndarray) -> np.ndarray:
    """Any image as floats in [0, 1]: integers over their maximum, values that are not finite 0, others clipped."""
    a = a / np.iinfo(a.dtype).max if a.dtype.kind == "u" else a.astype(float)
    return np.clip(np.where(np.isfinite(a), a, 0), 0, 1)


def encode_exr(channels: dict[str, np.ndarray]) -> bytes:
    """Channels (h, w) as 32-bit floats in scan lines without compression."""
    names = sorted(channels)
    h, w = channels[names[0]].shape
    box = struct.pack("<4i", 0, 0, w - 1, h - 1)
    listed = b"".join(n.encode() + b"\0" + struct.pack("<i4x2i", 2, 1, 1) for n in names) + b"\0"
    attributes = [
        ("channels", "chlist", listed), ("compression", "compression", b"\0"), ("dataWindow", "box2i", box), ("displayWindow", "box2i", box), ("lineOrder", "lineOrder", b"\0"),
        ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)), ("screenWindowWidth", "float", struct.pack("<f", 1)),
    ]
    head = struct.pack("<2i", _EXR, 2) + b"".join(n.encode() + b"\0" + k.encode() + b"\0" + struct.pack("<i", len(v)) + v for n, k, v in attributes) + b"\0"
    line = np.stack([channels[n].astype("<f4") for n in names], axis=1)
    size = 4 * w * len(names)
    first = len(head) + 8 * h
    return head + struct.pack(f"<{h}Q", *[first + y * (8 + size) for y in range(h)]) + b"".join(struct.pack("<2i", y, size) + line[y].tobytes() for y in range(h))


def decode_exr(content: bytes) -> dict[str, np.ndarray]:
    """Channels (h, w) of a scan-line file without compression or with either zip form."""
    if struct.unpack_from("<i", content)[0] != _EXR:
        raise ValueError("not an EXR file")
    at, found = 8, {}
    while content[at]:
        name, kind, rest = content[at:].split(b"\0", 2)
        at += len(name) + len(kind) + 2
        (size,) = struct.unpack_from("<i", content, at)
        found[name.decode()] = content[at + 4 : at + 4 + size]
        at += 4 + size
    at += 1
    x0, y0, x1, y1 = struct.unpack("<4i", found["dataWindow"])
    w, h, listed, channels = x1 - x0 + 1, y1 - y0 + 1, found["channels"], []
    while listed and listed[0]:
        name, listed = listed.split(b"\0", 1)
        channels.append((name.decode(), _TYPES[struct.unpack_from("<i", listed)[0]]))
        listed = listed[16:]
    packed = found["compression"][0]
    if packed not in (0, 2, 3):
        raise ValueError("this compression is not read")
    lines = 16 if packed == 3 else 1
    out = {n: np.zeros((h, w), np.float64) for n, _ in channels}
    width = sum(np.dtype(t).itemsize for _, t in channels) * w
    for offset in struct.unpack_from(f"<{-(-h // lines)}Q", content, at):
        y, size = struct.unpack_from("<2i", content, offset)
        data, n = content[offset + 8 : offset + 8 + size], min(lines, y0 + h - y)
        if packed and size < width * n:
            d = np.frombuffer(zlib.decompress(data), np.uint8)
            d = ((np.cumsum(d, dtype=np.int64) - 128 * np.arange(len(d))) & 255).astype(np.uint8)
            both = np.empty(len(d), np.uint8)
            both[0::2], both[1::2] = d[: (len(d) + 1) // 2], d[(len(d) + 1) // 2 :]
            data = both.tobytes()
        place = 0
        for k in range(n):
            for name, kind in channels:
                out[name][y - y0 + k] = np.frombuffer(data, kind, w, place)
                place += np.dtype(kind).itemsize * w
    return out


def exr_channel(content: bytes, name: str) -> np.ndarray:
    channels = decode_exr(content)
    if name not in channels:
        raise KeyError(f"no channel {name}")
    return channels[name]


def exr_rgb(content: bytes) -> np.ndarray | None:
    """(h, w, 3): red, or the grey channel that stands for it; missing green and blue are red; else the first three; None if unreadable."""
    try:
        channels = decode_exr(content)
        red = next((n for n in ("R", "r", "Y", "y") if n in channels), None)
        if red is None:
            return np.stack(list(channels.values())[:3], axis=-1) if len(channels) >= 3 else None
        pick = lambda *names: channels[next((n for n in names if n in channels), red)]
        return np.stack([channels[red], pick("G", "g"), pick("B", "b")], axis=-1)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None


def encode_npz(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def decode_npz(content: bytes, key: str) -> np.ndarray:
    with np.load(io.BytesIO(content), allow_pickle=False) as found:
        return found[key]


def encode_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def decode_npy(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)
