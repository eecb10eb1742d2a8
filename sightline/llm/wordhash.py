"""Words of many texts at once, as arrays: where each word stands and a 64-bit hash of its bytes.

Works on the bytes of an Arrow string column, without a Python object for each word.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
#: The constants of a 64-bit finalizer.
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits, one to one."""
    x = x ^ (x >> _U(30))
    x *= _U(_M1)
    x ^= x >> _U(27)
    x *= _U(_M2)
    x ^= x >> _U(31)
    return x


@functools.cache
def _factors(lane: int, n: int) -> np.ndarray:
    """``n`` odd numbers without any rule among them; the same in every process."""
    raw = hashlib.shake_256(f"lane {lane}".encode()).digest(8 * n)
    return np.frombuffer(raw, "<u8").astype(_U) | _U(1)


class Words:
    """``start``, ``end``: byte offsets of each word in ``data``; ``hash``: of its bytes;
    ``first``: number of the first word of each text (one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, solid_bytes: np.ndarray | None = None):
        """``data``: bytes (uint8); ``offsets``: where each text begins, and the end of the last.
        Words are runs of other bytes than 32 and 9 to 13, or of those that ``solid_bytes`` (256
        flags) has; with ``lower``, A-Z count as a-z."""
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = np.ones(n + 2, bool)
        solid[0] = solid[-1] = False
        if solid_bytes is None:
            solid[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        else:
            solid[1:-1] = solid_bytes[data]
        change = solid[1:] != solid[:-1]
        # a text's first byte begins a word even if the text before ends with one
        joint = offsets[1:-1]
        joint = joint[(joint > 0) & (joint < n)]
        joint = np.unique(joint[solid[joint] & solid[joint + 1]])
        edges = np.flatnonzero(change)
        starts, ends = edges[::2], edges[1::2]
        if len(joint):
            starts = np.sort(np.concatenate([starts, joint]))
            ends = np.sort(np.concatenate([ends, joint]))
        self.start, self.end = starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.lower = lower
        self.hash = self.hashes(0)

    def hashes(self, lane: int) -> np.ndarray:
        """Hash of each word.  Every eight bytes are mixed into what came before; the ``lane``s are independent of each
        other.  Words of more than eight bytes can be made up so that one lane's hashes are equal, not both lanes'."""
        out = np.empty(len(self.start), _U)
        key = _factors(lane, 4)
        step = 1 << 16
        for i in range(0, len(out), step):
            start, end = self.start[i : i + step], self.end[i : i + step]
            a, b = int(start[0]), int(end[-1])
            part = np.zeros(b - a + 8, np.uint8)
            part[: b - a] = self.data[a:b]
            if self.lower:
                part += np.uint8(32) * ((part >= 65) & (part <= 90))
            eight = np.ndarray(b - a + 1, "<u8", part, strides=(1,))  # the eight bytes from each byte on
            at, left = start - a, end - start
            h = mix(left.astype(_U) * key[0] + key[1])
            live = np.flatnonzero(left <= LONG_WORD)
            at, left = at[live], left[live]
            while len(live):
                x = eight[at]
                short = left < 8
                x[short] &= (_U(1) << (left[short] * 8).astype(_U)) - _U(1)
                h[live] = mix((h[live] ^ x) * key[2] + key[3])
                more = left > 8
                live, at, left = live[more], at[more] + 8, left[more] - 8
            for j in np.flatnonzero(end - start > LONG_WORD).tolist():
                word = part[start[j] - a : end[j] - a].tobytes()
                h[j] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([lane])).digest(), "little")
            out[i : i + step] = h
        return out

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1, joined by one space."""
        d = self.data
        return " ".join(d[a:b].tobytes().decode() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))


def runs(word_hash: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` words, by its first word; each place in a run has a factor of its own."""
    k = len(word_hash) - n + 1
    if k <= 0:
        return np.zeros(0, _U)
    out = np.zeros(k, _U)
    for i, f in enumerate(_factors(lane + 2, n)):
        out += word_hash[i : i + k] * f
    return mix(out)


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o.astype(np.int64)


def slices(offsets: np.ndarray, most: int):
    """(first, last) ranges of texts of about ``most`` bytes; a long text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
