"""Words of letters, digits and all beyond ASCII, found for a whole batch of texts at once."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z count as a-z; words are runs of what `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` is then.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b > 127 for b in range(256)])
#: The published table of crc32, made by its rule.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
#: Longer words are hashed one by one, so that one word does not make a step a byte for all.
LONG = 48


@dataclass
class Words:
    """The words of some texts in a row: their bytes are data[starts[i]:ends[i]], and text t's
    words are those from first[t] to first[t + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.Array) -> Words:
    """The lower-cased words of texts; null and empty ones have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = INSIDE[data]
    # a word begins where the byte before is outside or of another text
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def by_bytes(texts: pa.Array, most: int = 1 << 22):
    """(from, to) of runs of texts with about `most` bytes together; a longer text is alone."""
    sizes = np.cumsum(np.array([0, *(pc.binary_length(texts.cast(pa.large_string())).fill_null(0).to_pylist())], np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield at, to
        at = to


def crc_words(found: Words, states: np.ndarray | None = None, which: np.ndarray | None = None) -> np.ndarray:
    """crc32 states (before the last inversion) of words `which`, or of all, going on from `states`."""
    starts, ends = (found.starts, found.ends) if which is None else (found.starts[which], found.ends[which])
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32) if states is None else states.copy()
    sizes = ends - starts
    by_size = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    long_ = by_size[: np.count_nonzero(sizes > LONG)]
    for i in long_.tolist():
        state[i] = zlib.crc32(found.data[starts[i] : ends[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    rest = by_size[len(long_) :]
    at, crc, size = starts[rest], state[rest], sizes[rest]
    going = np.searchsorted(-size, -np.arange(LONG + 1), side="left")  # how many have more than so many bytes
    for step in range(LONG):
        k = going[step]
        if not k:
            break
        crc[:k] = _CRC[(crc[:k] ^ found.data[at[:k] + step]) & 0xFF] ^ (crc[:k] >> 8)
    state[rest] = crc
    return state


def crc_space(states: np.ndarray) -> np.ndarray:
    """The states after one more space."""
    return _CRC[(states ^ 32) & 0xFF] ^ (states >> 8)
