"""Pictures without a plotting library: pixels, small letters, colour scales, and PNG files by zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Letters of three by five pixels, rows from the top, three bits each.
_GLYPHS = {
    "0": 0o75557, "1": 0o26227, "2": 0o71747, "3": 0o71717, "4": 0o55711, "5": 0o74717, "6": 0o74757, "7": 0o71222, "8": 0o75757, "9": 0o75717,
    "A": 0o25755, "B": 0o65656, "C": 0o34443, "D": 0o65556, "E": 0o74647, "F": 0o74644, "G": 0o34553, "H": 0o55755, "I": 0o72227, "J": 0o11152,
    "K": 0o55655, "L": 0o44447, "M": 0o57755, "N": 0o65555, "O": 0o25552, "P": 0o65644, "Q": 0o25573, "R": 0o65655, "S": 0o34216, "T": 0o72222,
    "U": 0o55557, "V": 0o55552, "W": 0o55775, "X": 0o55255, "Y": 0o55222, "Z": 0o71247, ".": 0o00002, "-": 0o00700, "_": 0o00007, "/": 0o11244,
    ":": 0o02020, "%": 0o51245, "=": 0o07070, "(": 0o12221, ")": 0o42224,
}
#: Anchors of the colour scales, dark to bright.
SCALES = {
    "dusk": [(18, 14, 60), (40, 70, 130), (30, 140, 140), (110, 195, 90), (250, 230, 60)],
    "ember": [(5, 5, 15), (85, 20, 100), (190, 50, 75), (245, 140, 35), (252, 250, 170)],
    "grey": [(0, 0, 0), (255, 255, 255)],
}


def encode(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def decode(content: bytes) -> np.ndarray:
    """Pixels of a file that ``encode`` made."""
    width, height = struct.unpack(">II", content[16:24])
    at, data = 33, b""
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data += content[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)


def blank(height: int, width: int) -> np.ndarray:
    return np.full((height, width, 3), 255, np.uint8)


def write(pixels: np.ndarray, top: int, left: int, text: str, colour=(0, 0, 0)) -> None:
    """Letters at a place, cut where the picture ends; what has no letter is a gap."""
    for i, c in enumerate(text.upper()):
        bits = np.array([int(b) for b in f"{_GLYPHS.get(c, 0):015b}"], bool).reshape(5, 3)
        y, x = np.nonzero(bits)
        y, x = y + top, x + left + 4 * i
        inside = (y < pixels.shape[0]) & (x < pixels.shape[1])
        pixels[y[inside], x[inside]] = colour


def scaled(values: np.ndarray, scale: str = "dusk") -> np.ndarray:
    """Values as colours, from the least to the greatest of them; equal ones and what is no number are dark."""
    if scale not in SCALES:
        raise ValueError(f"unknown colours {scale}; one of {', '.join(SCALES)}")
    anchors = np.array(SCALES[scale], float)
    good = np.isfinite(values)
    lo, hi = (values[good].min(), values[good].max()) if good.any() else (0.0, 0.0)
    share = np.where(good, (values - lo) / (hi - lo), 0.0) if hi > lo else np.zeros_like(values)
    at = np.nan_to_num(share) * (len(anchors) - 1)
    low = np.minimum(at.astype(int), len(anchors) - 2)
    return np.round(anchors[low] + (anchors[low + 1] - anchors[low]) * (at - low)[..., None]).astype(np.uint8)


def hue(share: np.ndarray) -> np.ndarray:
    """Strong colours around the circle for shares from 0 to 1."""
    turn = np.asarray(share, float)[..., None] * 6 + np.array([0.0, 4.0, 2.0])
    return np.round(255 * (0.15 + 0.7 * np.clip(np.abs(turn % 6 - 3) - 1, 0, 1))).astype(np.uint8)
