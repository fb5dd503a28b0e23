"""AES-128 block and stream ciphers, vectorised over blocks, with the modes that media protection uses.

The tables follow from arithmetic in GF(2**8), so none is written out. Blocks are rows of a numpy array and every round is
one step over all of them; only chaining in CBC encryption goes block by block, by tables of whole states.
"""

from __future__ import annotations

import functools
import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType


def _field() -> tuple[np.ndarray, np.ndarray]:
    """The S-box and its inverse: the inverse in GF(2**8) modulo x^8+x^4+x^3+x+1, then an affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for k in range(255):
        power[k], log[x] = x, k
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    box = np.zeros(256, np.uint8)
    for v in range(256):
        inv = power[(255 - log[v]) % 255] if v else 0
        y = inv
        for r in range(1, 5):
            y ^= (inv << r | inv >> (8 - r)) & 0xFF
        box[v] = y ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back


def _times(a: np.ndarray, k: int) -> np.ndarray:
    out, a = np.zeros_like(a), a.copy()
    while k:
        if k & 1:
            out ^= a
        a = (a << 1) ^ np.where(a & 0x80, 0x1B, 0).astype(np.uint8)
        k >>= 1
    return out


SBOX, INVERSE = _field()
_BYTES = np.arange(256, dtype=np.uint8)
_TIMES = {k: _times(_BYTES, k) for k in (2, 3, 9, 11, 13, 14)}
#: A state is 16 bytes by columns; rows shift by their number.
_SHIFT = np.array([(4 * (c + r) + r) % 16 for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)


def expand_key(key: bytes) -> np.ndarray:
    """Eleven round keys of a 128-bit key."""
    if len(key) != 16:
        raise ValueError("a key of 16 bytes is wanted")
    words = [np.frombuffer(key, np.uint8)[4 * k : 4 * k + 4].copy() for k in range(4)]
    constant = 1
    for k in range(4, 44):
        w = words[-1].copy()
        if k % 4 == 0:
            w = SBOX[np.roll(w, -1)]
            w[0] ^= constant
            constant = constant << 1 ^ (0x11B if constant & 0x80 else 0)
        words.append(words[k - 4] ^ w)
    return np.concatenate(words).reshape(11, 16)


def _mix(s: np.ndarray, a: int, b: int, c: int, d: int) -> np.ndarray:
    m = s.reshape(-1, 4, 4)
    t = lambda k, x: x if k == 1 else _TIMES[k][x]
    r = [m[:, :, k] for k in range(4)]
    return np.stack([t(a, r[k]) ^ t(b, r[(k + 1) % 4]) ^ t(c, r[(k + 2) % 4]) ^ t(d, r[(k + 3) % 4]) for k in range(4)], axis=2).reshape(-1, 16)


@functools.cache
def _columns(back: bool) -> list[np.ndarray]:
    """What a byte of each row of a state adds to a column after a round, as one number of four bytes."""
    box, mix = (INVERSE, (14, 9, 13, 11)) if back else (SBOX, (2, 1, 1, 3))
    first = np.stack([box if k == 1 else _TIMES[k][box] for k in mix], 1)
    return [np.ascontiguousarray(np.roll(first, r, 1)).view("<u4").reshape(-1) for r in range(4)]


#: Blocks that go through all rounds at a time, so that states stay in a processor's cache.
_BLOCKS = 1 << 12


def _through(keys: np.ndarray, blocks: np.ndarray, back: bool) -> np.ndarray:
    """Blocks through all rounds, a column of four bytes at a time."""
    tables, box, places = _columns(back), INVERSE if back else SBOX, (_UNSHIFT if back else _SHIFT).reshape(4, 4)
    if back:  # the equivalent inverse cipher, whose round keys are mixed too
        keys = np.vstack([keys[10:], _mix(keys[9:0:-1].reshape(-1, 16), 14, 11, 13, 9), keys[:1]])
    out = np.empty_like(blocks)
    wide = np.ascontiguousarray(keys).view("<u4")
    for at in range(0, len(blocks), _BLOCKS):
        s = blocks[at : at + _BLOCKS] ^ keys[0]
        for k in range(1, 10):
            new = np.empty((len(s), 4), "<u4")
            for c in range(4):
                p = places[c]
                x = tables[0][s[:, p[0]]]
                for r in range(1, 4):
                    x ^= tables[r][s[:, p[r]]]
                new[:, c] = x ^ wide[k, c]
            s = new.view(np.uint8)
        out[at : at + _BLOCKS] = box[s[:, places.reshape(-1)]] ^ keys[10]
    return out


def encrypt_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return _through(keys, blocks, False)


def decrypt_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return _through(keys, blocks, True)


@functools.cache
def _by_byte() -> tuple[list[list[int]], list[list[int]]]:
    """What a byte at each place of a state adds to the state after a round, and after the last one, as whole states."""
    rounds, last = [], []
    for place in range(16):
        s = np.zeros((256, 16), np.uint8)
        s[:, place] = SBOX
        s = s[:, _SHIFT]
        for out, rows in ((rounds, _mix(s, 2, 3, 1, 1)), (last, s)):
            out.append([int.from_bytes(r.tobytes(), "big") for r in rows])
    return rounds, last


def _chained(keys: np.ndarray, iv: bytes, data: bytes) -> bytes:
    """CBC encryption, where each block needs the one before: a state is one number, and a round sixteen look-ups."""
    rounds, last = _by_byte()
    own = [int.from_bytes(k.tobytes(), "big") for k in keys]
    x, out = int.from_bytes(iv, "big"), []
    for at in range(0, len(data) - 15, 16):
        x ^= int.from_bytes(data[at : at + 16], "big") ^ own[0]
        for k in range(1, 11):
            y = own[k]
            for table, b in zip(rounds if k < 10 else last, x.to_bytes(16, "big")):
                y ^= table[b]
            x = y
        out.append(x.to_bytes(16, "big"))
    return b"".join(out)


def _rows(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, 16)


def ecb(key: bytes, data: bytes, decrypt: bool = False) -> bytes:
    return (decrypt_blocks if decrypt else encrypt_blocks)(expand_key(key), _rows(data)).tobytes()


def ctr(key: bytes, iv: bytes, data: bytes, offset: int = 0) -> bytes:
    """Counter mode from byte ``offset`` of the stream; an IV of 8 bytes is followed by a counter from 0."""
    if not data:
        return b""
    first, skip = divmod(offset, 16)
    start = int.from_bytes(iv.ljust(16, b"\0"), "big") + first
    n = -(-(skip + len(data)) // 16)
    low = [(start + k) % (1 << 128) for k in (0, n - 1)]
    if low[0] >> 64 == low[1] >> 64:
        counters = np.empty((n, 2), ">u8")
        counters[:, 0] = low[0] >> 64
        counters[:, 1] = np.uint64(low[0] & (1 << 64) - 1) + np.arange(n, dtype=np.uint64)
        blocks = counters.view(np.uint8).reshape(n, 16)
    else:
        blocks = _rows(b"".join(((start + k) % (1 << 128)).to_bytes(16, "big") for k in range(n)))
    stream = encrypt_blocks(expand_key(key), blocks).reshape(-1)[skip : skip + len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


#: Streams of blocks below which chains go one by one.
_LANES = 12


def chained(keys: np.ndarray, ivs: list[bytes], streams: list[bytes]) -> list[bytes]:
    """CBC encryption of many streams of whole blocks: a step takes one block of each, as only within a stream a block needs
    the one before. What is left of few long streams goes block by block."""
    counts = np.array([len(d) // 16 for d in streams], np.int64)
    order = np.argsort(-counts, kind="stable")
    counts = counts[order]
    out = [bytearray(len(streams[i])) for i in order]
    sources = [streams[i] for i in order]
    last = np.frombuffer(b"".join(ivs[i] for i in order), np.uint8).reshape(-1, 16).copy()
    begun = int(counts[_LANES - 1]) if len(counts) >= _LANES else 0  # blocks that so many streams have
    for at in range(0, begun, _STEPS):
        n = int(np.searchsorted(-counts, -at, "left"))  # streams with more than ``at`` blocks
        m = min(_STEPS, begun - at)
        part = np.zeros((n, 16 * m), np.uint8)
        for i in range(n):
            piece = np.frombuffer(sources[i], np.uint8, min(m, int(counts[i]) - at) * 16, 16 * at)
            part[i, : len(piece)] = piece
        for k in range(m):
            live = int(np.searchsorted(-counts, -(at + k), "left"))
            last[:live] = encrypt_blocks(keys, last[:live] ^ part[:live, 16 * k : 16 * k + 16])
            part[:live, 16 * k : 16 * k + 16] = last[:live]
        for i in range(n):
            size = min(m, int(counts[i]) - at) * 16
            out[i][16 * at : 16 * at + size] = part[i, :size].tobytes()
    for i in range(int(np.searchsorted(-counts, -begun, "left"))):
        out[i][16 * begun :] = _chained(keys, last[i].tobytes(), sources[i][16 * begun :])
    done = [b""] * len(streams)
    for i, k in enumerate(order):
        done[k] = bytes(out[i])
    return done


#: Blocks of each stream that are laid side by side at a time.
_STEPS = 64


def cbc_many(key: bytes, ivs: list[bytes], streams: list[bytes], decrypt: bool = False) -> list[bytes]:
    """CBC of many streams of whole blocks, each from its own vector."""
    keys = expand_key(key)
    if not decrypt:
        return chained(keys, ivs, streams)
    rows = _rows(b"".join(streams))
    clear = decrypt_blocks(keys, rows)
    starts = np.cumsum([0, *(len(d) // 16 for d in streams)])
    own = [k for k, d in enumerate(streams) if d]
    before = np.vstack([np.zeros((1, 16), np.uint8), rows[:-1]]) if len(rows) else rows
    if own:
        before[starts[own]] = np.frombuffer(b"".join(ivs[k] for k in own), np.uint8).reshape(-1, 16)
    whole = (clear ^ before).tobytes()
    return [whole[16 * a : 16 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def ctr_many(key: bytes, ivs: list[bytes], streams: list[bytes]) -> list[bytes]:
    """Counter mode of many streams, each from its own vector."""
    counts = np.array([-(-len(d) // 16) for d in streams], np.int64)
    starts = np.cumsum(counts) - counts
    begin = [int.from_bytes(iv.ljust(16, b"\0"), "big") for iv in ivs]
    low = np.array([x & (1 << 64) - 1 for x in begin], np.uint64)
    inside = (np.arange(int(counts.sum())) - np.repeat(starts, counts)).astype(np.uint64)
    counters = np.empty((len(inside), 2), ">u8")
    count = np.repeat(low, counts) + inside
    counters[:, 1] = count
    high = np.repeat(np.array([x >> 64 for x in begin], np.uint64), counts)
    counters[:, 0] = high + (count < inside)  # a low half that passes its end
    stream = encrypt_blocks(expand_key(key), counters.view(np.uint8).reshape(-1, 16)).reshape(-1)
    return [(np.frombuffer(d, np.uint8) ^ stream[16 * a : 16 * a + len(d)]).tobytes() if d else b"" for d, a in zip(streams, starts.tolist())]


def cbc(key: bytes, iv: bytes, data: bytes, decrypt: bool = False, pad: bool = False) -> bytes:
    """Cipher block chaining; with ``pad`` by PKCS#7, else whole blocks only."""
    keys = expand_key(key)
    if decrypt:
        rows = _rows(data)
        before = np.vstack([_rows(iv), rows[:-1]]) if len(rows) else rows
        out = (decrypt_blocks(keys, rows) ^ before).tobytes() if len(rows) else b""
        if pad:
            n = out[-1] if out else 0
            if not 1 <= n <= 16 or out[-n:] != bytes([n]) * n:
                raise ValueError("bad padding")
            out = out[:-n]
        return out
    if pad:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    return _chained(keys, iv, data)


def pattern(key: bytes, iv: bytes, data: bytes, crypt: int, skip: int, mode: str, decrypt: bool = False) -> bytes:
    """Of every ``crypt + skip`` blocks the first ``crypt`` go through the cipher as one stream; the rest, and a last
    part of a block, stay. With ``skip`` 0 all whole blocks do."""
    whole = len(data) // 16
    period = crypt + skip
    on = np.ones(whole, bool) if not skip or not period else np.arange(whole) % period < crypt
    rows = np.frombuffer(data[: 16 * whole], np.uint8).reshape(-1, 16).copy()
    body = rows[on].tobytes()
    rows[on] = _rows(ctr(key, iv, body) if mode == "ctr" else cbc(key, iv, body, decrypt)) if body else rows[on]
    return rows.tobytes() + data[16 * whole :]


def wrap_key(kek: bytes, key: bytes, unwrap: bool = False) -> bytes:
    """RFC 3394 key wrapping; unwrapping checks the integrity value."""
    n = len(key) // 8 - (1 if unwrap else 0)
    parts = [key[8 * k : 8 * k + 8] for k in range(len(key) // 8)]
    a, r = (parts[0], parts[1:]) if unwrap else (b"\xa6" * 8, parts)
    steps = [(j, i) for j in range(6) for i in range(n)]
    for j, i in reversed(steps) if unwrap else steps:
        t = (n * j + i + 1).to_bytes(8, "big")
        if unwrap:
            b = ecb(kek, bytes(x ^ y for x, y in zip(a, t)) + r[i], decrypt=True)
            a, r[i] = b[:8], b[8:]
        else:
            b = ecb(kek, a + r[i])
            a, r[i] = bytes(x ^ y for x, y in zip(b[:8], t)), b[8:]
    if unwrap:
        if a != b"\xa6" * 8:
            raise ValueError("the wrapped key is damaged")
        return b"".join(r)
    return a + b"".join(r)


def hmac_sha256(key: bytes, data: bytes) -> bytes:
    return hmac.new(key, data, hashlib.sha256).digest()


def protection_header(system_id: bytes, data: bytes, kids: list[bytes] | None = None) -> bytes:
    """A protection system box of version 0, or of version 1 with key ids."""
    body = (b"\1\0\0\0" if kids is not None else bytes(4)) + system_id
    if kids is not None:
        body += len(kids).to_bytes(4, "big") + b"".join(kids)
    body += len(data).to_bytes(4, "big") + data
    return (len(body) + 8).to_bytes(4, "big") + b"pssh" + body


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def tagged_fields(fields: list[tuple[int, int | bytes]]) -> bytes:
    """(number, value) pairs as a protocol buffer message: integers as varints, bytes with their length."""
    return b"".join(varint(k << 3 | (2 if isinstance(v, bytes) else 0)) + (varint(len(v)) + v if isinstance(v, bytes) else varint(v)) for k, v in fields)


def derive_content_key(seed: bytes, kid: bytes) -> bytes:
    """A content key from a 30-byte key seed and a key id in its little-endian GUID order: folded SHA-256 sums."""
    seed = seed[:30]
    guid = kid[3::-1] + kid[5:3:-1] + kid[7:5:-1] + kid[8:]
    sums = [hashlib.sha256(x).digest() for x in (seed + guid, seed + guid + seed, seed + guid + seed + guid)]
    return bytes(np.bitwise_xor.reduce([np.frombuffer(s[h : h + 16], np.uint8) for s in sums for h in (0, 16)]))


def key_checksum(kid: bytes, key: bytes) -> bytes:
    guid = kid[3::-1] + kid[5:3:-1] + kid[7:5:-1] + kid[8:]
    return ecb(key, guid)[:8]


@pandas_udf(BinaryType())
def ctr_udf(key: pd.Series, iv: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else ctr(bytes(k), bytes(i), bytes(d)) for k, i, d in zip(key, iv, data)])


@pandas_udf(BinaryType())
def cbc_encrypt_udf(key: pd.Series, iv: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else cbc(bytes(k), bytes(i), bytes(d)) for k, i, d in zip(key, iv, data)])


@pandas_udf(BinaryType())
def cbc_decrypt_udf(key: pd.Series, iv: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else cbc(bytes(k), bytes(i), bytes(d), decrypt=True) for k, i, d in zip(key, iv, data)])


@pandas_udf(BinaryType())
def hmac_udf(key: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else hmac_sha256(bytes(k), bytes(d)) for k, d in zip(key, data)])
