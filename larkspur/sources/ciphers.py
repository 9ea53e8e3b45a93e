"""RC4 and AES (CBC), as documents that open without a password use them; AES runs over all blocks at once."""

from __future__ import annotations

import numpy as np


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    i = j = 0
    out = bytearray(len(data))
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        a = state[i]
        j = (j + a) & 255
        b = state[j]
        state[i], state[j] = b, a
        out[n] = byte ^ state[(a + b) & 255]
    return bytes(out)


def _doubled(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The substitution, its inverse, and products with the factors of column mixing, from arithmetic in GF(2^8)."""
    power, log, x = [0] * 255, [0] * 256, 1
    for n in range(255):
        power[n], log[x] = x, n
        x = _doubled(x) ^ x  # times 3, which generates the field
    times = lambda a, b: power[(log[a] + log[b]) % 255] if a and b else 0
    box = []
    for v in range(256):
        inverse = power[-log[v] % 255] if v else 0
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 255
        box.append(turned ^ 0x63)
    forth = np.array(box, dtype=np.uint8)
    back = np.zeros(256, dtype=np.uint8)
    back[forth] = np.arange(256)
    return forth, back, {f: np.array([times(f, v) for v in range(256)], dtype=np.uint8) for f in (1, 2, 3, 9, 11, 13, 14)}


_FORTH, _BACK, _TIMES = _tables()
#: For each row what a substituted and mixed byte gives to its column.
_PARTS = [[int.from_bytes(bytes(_TIMES[(2, 1, 1, 3)[(i - row) % 4]][_FORTH[v]] for i in range(4))) for v in range(256)] for row in range(4)]
#: Where row shifting takes each of a block's 16 bytes from (columns of four).
_SHIFTED = np.array([4 * ((c + r) % 4) + r for c in range(4) for r in range(4)])
_UNSHIFTED = np.argsort(_SHIFTED)


class Aes:
    def __init__(self, key: bytes):
        words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        n, self.rounds, constant = len(words), len(words) + 6, 1
        while len(words) < 4 * (self.rounds + 1):
            last, i = words[-1], len(words)
            if i % n == 0:
                last = [int(_FORTH[b]) for b in (*last[1:], last[0])]
                last[0] ^= constant
                constant = _doubled(constant)
            elif n > 6 and i % n == 4:
                last = [int(_FORTH[b]) for b in last]
            words.append([a ^ b for a, b in zip(words[-n], last, strict=True)])
        self.keys = np.array(words, dtype=np.uint8).reshape(-1, 16)

    @staticmethod
    def _mixed(blocks: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
        columns = blocks.reshape(-1, 4, 4)
        out = np.zeros_like(columns)
        for row in range(4):
            for k in range(4):
                out[:, :, row] ^= _TIMES[factors[(k - row) % 4]][columns[:, :, k]]
        return out.reshape(-1, 16)

    def decrypted(self, blocks: np.ndarray) -> np.ndarray:
        state = blocks ^ self.keys[-1]
        for r in range(self.rounds - 1, -1, -1):
            state = _BACK[state[:, _UNSHIFTED]] ^ self.keys[r]
            state = state if r == 0 else self._mixed(state, (14, 11, 13, 9))
        return state

    def cbc_decrypted(self, start: bytes, data: bytes) -> bytes:
        """Whole blocks of ``data``; what is over is left away."""
        blocks = np.frombuffer(data[: len(data) // 16 * 16], dtype=np.uint8).reshape(-1, 16)
        before = np.vstack([np.frombuffer(start, dtype=np.uint8), blocks[:-1]]) if len(blocks) else blocks
        return (self.decrypted(blocks) ^ before).tobytes()

    def cbc_encrypted(self, start: bytes, data: bytes) -> bytes:
        """Block after block, since each needs the one before: columns as whole numbers, a table for each row's part."""
        keys = [int.from_bytes(k[i : i + 4].tobytes()) for k in self.keys for i in range(0, 16, 4)]
        (a, b, c, d), box, out = _PARTS, _FORTH.tolist(), bytearray()
        w, x, y, z = (int.from_bytes(start[i : i + 4]) for i in range(0, 16, 4))
        for at in range(0, len(data), 16):
            w, x, y, z = (v ^ int.from_bytes(data[at + i : at + i + 4]) ^ k for v, i, k in zip((w, x, y, z), range(0, 16, 4), keys[:4], strict=True))
            for r in range(4, 4 * self.rounds, 4):
                w, x, y, z = (
                    a[w >> 24] ^ b[x >> 16 & 255] ^ c[y >> 8 & 255] ^ d[z & 255] ^ keys[r],
                    a[x >> 24] ^ b[y >> 16 & 255] ^ c[z >> 8 & 255] ^ d[w & 255] ^ keys[r + 1],
                    a[y >> 24] ^ b[z >> 16 & 255] ^ c[w >> 8 & 255] ^ d[x & 255] ^ keys[r + 2],
                    a[z >> 24] ^ b[w >> 16 & 255] ^ c[x >> 8 & 255] ^ d[y & 255] ^ keys[r + 3],
                )
            turned = ((w, x, y, z), (x, y, z, w), (y, z, w, x), (z, w, x, y))
            w, x, y, z = ((box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ k for (p, q, r, s), k in zip(turned, keys[-4:], strict=True))
            out += b"".join(v.to_bytes(4) for v in (w, x, y, z))
        return bytes(out)


def unpadded(data: bytes) -> bytes:
    """Data without the bytes that fill its last block, each of which says how many they are."""
    return data[: -data[-1]] if data and 0 < data[-1] <= 16 else data
