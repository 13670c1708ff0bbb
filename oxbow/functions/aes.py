"""AES over many blocks at once, and the two modes that archives use."""

from __future__ import annotations

import functools
import hashlib
import hmac

import numpy as np

from oxbow.functions.hashing import sevenz_key, zip_aes_keys


def _doubled(b: int) -> int:
    return (b << 1 ^ (0x11B if b & 0x80 else 0)) & 0xFF


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _doubled(a), b >> 1
    return out


def _substitutions() -> np.ndarray:
    """Each byte's inverse in the field, then the affine map."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        inverse = next((c for c in range(1, 256) if _product(b, c) == 1), 0)
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 0xFF
        out[b] = turned ^ 0x63
    return out


_S = _substitutions()
_S_BACK = np.argsort(_S).astype(np.uint8)
_TIMES = {k: np.array([_product(b, k) for b in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}
#: A state's bytes go column by column; row r turns left by r places.
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_SHIFT_BACK = np.argsort(_SHIFT)


def _mixed_back(columns: np.ndarray) -> np.ndarray:
    """The columns (the last axis, four bytes) of a state before they were mixed."""
    out = _TIMES[14][columns]
    for k, times in ((1, 11), (2, 13), (3, 9)):
        out = out ^ _TIMES[times][np.roll(columns, -k, axis=-1)]
    return out


#: What a sealed byte in row r gives to its whole column: substituted back, then mixed back.
_BACK = [_mixed_back(np.where(np.arange(4) == r, _S_BACK[:, None], 0).astype(np.uint8)).copy().view(np.uint32)[:, 0] for r in range(4)]
#: Blocks at a time, so that the tables and the state stay in the cache.
_AT_ONCE = 4096


class Aes:
    """Key of 16, 24 or 32 bytes; blocks are rows of 16 bytes."""

    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("an AES key has 16, 24 or 32 bytes")
        n = len(key) // 4
        words, rcon = [list(key[4 * k : 4 * k + 4]) for k in range(n)], 1
        for k in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if k % n == 0:
                w = [int(_S[b]) for b in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _doubled(rcon)
            elif n == 8 and k % n == 4:
                w = [int(_S[b]) for b in w]
            words.append([a ^ b for a, b in zip(words[k - n], w)])
        self.rounds = np.array(words, np.uint8).reshape(-1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        x = blocks ^ self.rounds[0]
        for key in self.rounds[1:-1]:
            c = _S[x][:, _SHIFT].reshape(-1, 4, 4)
            turn = [np.roll(c, -k, axis=2) for k in range(1, 4)]
            x = (_TIMES[2][c] ^ _TIMES[3][turn[0]] ^ turn[1] ^ turn[2]).reshape(-1, 16) ^ key
        return _S[x][:, _SHIFT] ^ self.rounds[-1]

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        keys = [_mixed_back(key.reshape(4, 4)).copy().view(np.uint32)[:, 0] for key in self.rounds[-2:0:-1]]
        out = np.empty_like(blocks)
        for at in range(0, len(blocks), _AT_ONCE):
            x = blocks[at : at + _AT_ONCE] ^ self.rounds[-1]
            for key in keys:
                row = [_BACK[r].take(x.take(_SHIFT_BACK[r::4], axis=1)) for r in range(4)]
                x = (row[0] ^ row[1] ^ row[2] ^ row[3] ^ key).view(np.uint8)
            out[at : at + _AT_ONCE] = _S_BACK[x[:, _SHIFT_BACK]] ^ self.rounds[0]
        return out


def ctr_little_endian(key: bytes, data: bytes) -> bytes:
    """ZIP's counter mode: a little-endian counter from 1 on, of 16 bytes; its own inverse."""
    n = -(-len(data) // 16)
    counters = np.zeros((n, 2), "<u8")
    counters[:, 0] = np.arange(1, n + 1)
    stream = Aes(key).encrypt(counters.view(np.uint8).reshape(-1, 16)).reshape(-1)[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    if len(data) % 16:
        raise ValueError("the encrypted data are not whole blocks")
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.concatenate((np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1])) if len(blocks) else blocks
    return (Aes(key).decrypt(blocks) ^ before).tobytes()


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """The last block is filled up with zeros."""
    aes, last, out = Aes(key), np.frombuffer(iv, np.uint8).reshape(1, 16), []
    for block in np.frombuffer(data + bytes(-len(data) % 16), np.uint8).reshape(-1, 1, 16):
        last = aes.encrypt(block ^ last)
        out.append(last.tobytes())
    return b"".join(out)


def zip_aes_decrypt(raw: bytes, password: bytes, strength: int) -> bytes:
    """The packed bytes of a WinZip AES entry: salt, verifier, data, and ten bytes of HMAC-SHA-1."""
    if strength not in (1, 2, 3):
        raise ValueError("unknown strength of encryption")
    size, n = 8 + 8 * strength, 4 + 4 * strength
    if len(raw) < n + 12:
        raise ValueError("the encrypted data end too early")
    key, check, verifier = zip_aes_keys(password, raw[:n], size)
    if raw[n : n + 2] != verifier:
        raise ValueError("wrong password")
    body = raw[n + 2 : -10]
    if not hmac.compare_digest(hmac.new(check, body, "sha1").digest()[:10], raw[-10:]):
        raise ValueError("the encrypted data are damaged")
    return ctr_little_endian(key, body)


def zip_aes_encrypt(body: bytes, password: bytes, strength: int, salt: bytes) -> bytes:
    key, check, verifier = zip_aes_keys(password, salt, 8 + 8 * strength)
    sealed = ctr_little_endian(key, body)
    return salt + verifier + sealed + hmac.new(check, sealed, "sha1").digest()[:10]


_sevenz_key = functools.lru_cache(maxsize=64)(sevenz_key)


def sevenz_aes_props(props: bytes) -> tuple[int, bytes, bytes]:
    """(power, salt, initial vector) from the properties of a 7z AES coder."""
    first, second = props[0], props[1] if len(props) > 1 else 0
    n, m = (first >> 7 & 1) + (second >> 4), (first >> 6 & 1) + (second & 15)
    return first & 0x3F, props[2 : 2 + n], props[2 + n : 2 + n + m].ljust(16, b"\0")


def sevenz_aes_decrypt(raw: bytes, props: bytes, password: str) -> bytes:
    power, salt, iv = sevenz_aes_props(props)
    if power == 0x3F:  # no rounds: the salt and the password are the key
        key = (salt + password.encode("utf-16-le"))[:32].ljust(32, b"\0")
    elif power > 24:
        raise ValueError("too many rounds of key derivation")
    else:
        key = _sevenz_key(password, salt, power)
    return cbc_decrypt(key, iv, raw[: len(raw) // 16 * 16])


def digest_salt(name: str, n: int) -> bytes:
    """A salt for round trips, from a name."""
    return hashlib.sha256(name.encode()).digest()[:n]
