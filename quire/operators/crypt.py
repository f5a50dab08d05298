"""Encrypted PDF files: the standard security handler, revisions 2 to 6, for reading.

RC4 and AES are written here since no library for them is at hand; AES decrypts all blocks of a stream at
once on numpy arrays. Tables are built from the field arithmetic that defines them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5, sha256, sha384, sha512

import numpy as np

#: What shorter passwords are filled up with. Fixed value.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class WrongPassword(ValueError):
    pass


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n in range(len(data)):
        i = (i + 1) & 255
        a = state[i]
        j = (j + a) & 255
        b = state[i] = state[j]
        state[j] = a
        out[n] = state[(a + b) & 255]
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(out, np.uint8)).tobytes()


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


@lru_cache(maxsize=1)
def _boxes() -> tuple[list[int], list[int]]:
    """Substitution of bytes and its inverse: the field's inverse, then an affine map of the bits."""
    box = []
    for x in range(256):
        inverse = next((y for y in range(1, 256) if _times(x, y) == 1), 0)
        box.append(0x63 ^ inverse ^ (turned := inverse * 0x101) >> 7 & 255 ^ turned >> 6 & 255 ^ turned >> 5 & 255 ^ turned >> 4 & 255)
    return box, [box.index(x) for x in range(256)]


@lru_cache(maxsize=8)
def _product(factor: int) -> np.ndarray:
    return np.array([_times(factor, x) for x in range(256)], np.uint8)


@lru_cache(maxsize=64)
def _round_keys(key: bytes) -> list[bytes]:
    box, n = _boxes()[0], len(key) // 4
    words, power = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        word = words[i - 1]
        if i % n == 0:
            word = [box[b] for b in word[1:] + word[:1]]
            word[0] ^= power
            power = _times(power, 2)
        elif n > 6 and i % n == 4:
            word = [box[b] for b in word]
        words.append([a ^ b for a, b in zip(words[i - n], word, strict=True)])
    return [bytes(b for word in words[i : i + 4] for b in word) for i in range(0, len(words), 4)]


def aes_decrypt(key: bytes, data: bytes, before: bytes) -> bytes:
    """CBC, all blocks at once; ``before`` is the initial vector, an incomplete last block is left out."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    keys = [np.frombuffer(k, np.uint8) for k in _round_keys(key)]
    back = np.array(_boxes()[1], np.uint8)
    rows = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])
    mixes = [_product(f) for f in (14, 11, 13, 9)]
    state = blocks ^ keys[-1]
    for nth in range(len(keys) - 2, -1, -1):
        state = back[state[:, rows]] ^ keys[nth]
        if nth:
            columns = state.reshape(-1, 4, 4)
            state = np.stack([mixes[0][columns[:, :, r]] ^ mixes[1][columns[:, :, (r + 1) % 4]] ^ mixes[2][columns[:, :, (r + 2) % 4]] ^ mixes[3][columns[:, :, (r + 3) % 4]] for r in range(4)], 2).reshape(-1, 16)
    return (state ^ np.concatenate([np.frombuffer(before, np.uint8)[None], blocks[:-1]])[: len(state)]).tobytes()


@lru_cache(maxsize=1)
def _columns() -> list[list[int]]:
    """For each byte of a column what it adds to the mixed column after substitution, as 32 bits."""
    box = _boxes()[0]
    return [[sum(_times(m, box[x]) << 8 * r for r, m in enumerate(np.roll((2, 1, 1, 3), turn).tolist())) for x in range(256)] for turn in range(4)]


def aes_encrypt(key: bytes, data: bytes, before: bytes) -> bytes:
    """CBC of whole blocks, one after another."""
    keys = [[int.from_bytes(k[4 * i : 4 * i + 4], "little") for i in range(4)] for k in _round_keys(key)]
    one, two, three, four = _columns()
    box, out, last = _boxes()[0], [], int.from_bytes(before, "little")
    for at in range(0, len(data), 16):
        block = int.from_bytes(data[at : at + 16], "little") ^ last
        c = [(block >> 32 * i & 0xFFFFFFFF) ^ keys[0][i] for i in range(4)]
        for k in keys[1:-1]:
            c = [one[c[i] & 255] ^ two[c[i - 3] >> 8 & 255] ^ three[c[i - 2] >> 16 & 255] ^ four[c[i - 1] >> 24] ^ k[i] for i in range(4)]
        c = [(box[c[i] & 255] | box[c[i - 3] >> 8 & 255] << 8 | box[c[i - 2] >> 16 & 255] << 16 | box[c[i - 1] >> 24] << 24) ^ keys[-1][i] for i in range(4)]
        last = c[0] | c[1] << 32 | c[2] << 64 | c[3] << 96
        out.append(last.to_bytes(16, "little"))
    return b"".join(out)


def hardened(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of AES and of a SHA that the round before chooses."""
    k, n = sha256(password + salt + user).digest(), 0
    while True:
        e = aes_encrypt(k[:16], 64 * (password + k + user), k[16:32])
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


@dataclass
class Security:
    """The file's key, and how streams and strings are enciphered: rc4, aes, aes256 or none."""

    key: bytes
    streams: str
    strings: str
    metadata: bool = True

    def _plain(self, how: str, data: bytes, number: int, generation: int) -> bytes:
        if how == "none":
            return data
        key = self.key
        if how != "aes256":
            mark = number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2]
            key = md5(key + mark + (b"sAlT" if how == "aes" else b"")).digest()[: min(len(key) + 5, 16)]
        if how == "rc4":
            return rc4(key, data)
        made = aes_decrypt(key, data[16:], data[:16]) if len(data) >= 32 else b""
        return made[: -made[-1]] if made and 1 <= made[-1] <= 16 else made

    def string(self, data: bytes, number: int, generation: int) -> bytes:
        return self._plain(self.strings, data, number, generation)

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        return self._plain(self.streams, data, number, generation)


def _file_key(password: bytes, e: dict, first_id: bytes, n: int) -> bytes:
    made = md5((password + PAD)[:32] + e["O"][:32] + (e["P"] & 0xFFFFFFFF).to_bytes(4, "little") + first_id)
    if e["R"] >= 4 and e.get("EncryptMetadata") is False:
        made.update(b"\xff\xff\xff\xff")
    key = made.digest()
    for _ in range(50 if e["R"] >= 3 else 0):
        key = md5(key[:n]).digest()
    return key[:n]


def user_entry(key: bytes, revision: int, first_id: bytes) -> bytes:
    """What the file's U entry must begin with for this key."""
    if revision == 2:
        return rc4(key, PAD)
    made = md5(PAD + first_id).digest()
    for i in range(20):
        made = rc4(bytes(b ^ i for b in key), made)
    return made


def owner_key(password: bytes, revision: int, n: int) -> bytes:
    key = md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = md5(key[:n]).digest()
    return key[:n]


def _old(e: dict, first_id: bytes, password: bytes, n: int) -> bytes:
    owner = e["O"][:32]
    for i in range(19 if e["R"] >= 3 else 0, -1, -1):
        owner = rc4(bytes(b ^ i for b in owner_key(password, e["R"], n)), owner)
    for candidate in (password, owner):
        key = _file_key(candidate, e, first_id, n)
        want = user_entry(key, e["R"], first_id)
        if e["U"][: len(want)] == want:
            return key
    raise WrongPassword("password may be incorrect")


def _new(e: dict, password: bytes) -> bytes:
    password = password[:127]
    made = (lambda salt, user=b"": sha256(password + salt + user).digest()) if e["R"] == 5 else (lambda salt, user=b"": hardened(password, salt, user))
    for entry, sealed, user in ((e["U"], e["UE"], b""), (e["O"], e["OE"], e["U"][:48])):
        if made(entry[32:40], user) == entry[:32]:
            return aes_decrypt(made(entry[40:48], user), sealed[:32], bytes(16))
    raise WrongPassword("password may be incorrect")


def unlock(e: dict, first_id: bytes, password: str) -> Security:
    """The security of an Encrypt dictionary, all its references resolved; raises :class:`WrongPassword`."""
    if e.get("Filter") != "Standard" or e.get("V") not in (1, 2, 4, 5) or e.get("R") not in (2, 3, 4, 5, 6):
        raise WrongPassword(f"password may be incorrect, or this encryption isn't supported: {e.get('Filter')} V {e.get('V')} R {e.get('R')}")
    hows = []
    for which in ("StmF", "StrF"):
        method = (e.get("CF") or {}).get(e.get(which, "Identity"), {}).get("CFM", "None") if e["V"] >= 4 else "V2"
        hows.append({"V2": "rc4", "AESV2": "aes", "AESV3": "aes256", "None": "none"}.get(str(method), "none"))
    if e["V"] == 5:
        key = _new(e, password.encode())
    else:
        n = 5 if e["V"] == 1 else 16 if e["V"] == 4 else max(5, min(16, e.get("Length", 40) // 8))
        key = _old(e, first_id, password.encode("latin-1", "replace"), n)
    return Security(key, *hows, e.get("EncryptMetadata") is not False)
