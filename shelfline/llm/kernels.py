"""Array kernels over UTF-8 text that the tasks of this subpackage share.

They see one Arrow column at a time; Spark deals the rows out and brings results together.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# what Arrow frees then goes back to the system with release(), and is not kept by a pool of its own
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Bytes that belong to words: ASCII letters and digits, and every byte of a longer character.
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the usual splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S so that span_hash(S, a, b) names the bytes data[a:b]."""
    up, _ = powers(len(data) + 1)
    s = np.empty(len(data) + 1, dtype=np.uint64)
    s[0] = 0
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span that depends on its content only."""
    _, down = powers(len(s))
    return mix((s[end] - s[start]) * down[start])


def arrow_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def lines_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """As arrow_bytes, lower-cased, a newline after each value so that no word spans two."""
    col = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    ends = pa.repeat(pa.scalar("\n", pa.large_string()), len(col))
    return arrow_bytes(pc.binary_join_element_wise(pc.utf8_lower(col), ends, pa.scalar("", pa.large_string())))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each value's first word (n + 1 numbers)."""
    inside = WORD_BYTE[data].view(np.int8)
    edge = np.diff(inside, prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hashes(data), start, end)


def blocks(table: pa.Table, size_of: np.ndarray, most: int):
    """Consecutive slices of a table whose sizes add up to about `most`; a larger row stands alone."""
    total = np.concatenate([[0], np.cumsum(size_of)])
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield table.slice(at, to - at)
        at = to


def sizes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def release() -> None:
    """Gives freed memory back to the system, so that a reused worker does not keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
