"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from lodestone.llm.common import mix64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered; none for null."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_LOWER).split()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole sequence where there are fewer; empty without words."""
    own = words(text)
    if not own:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = mix64(h ^ w[i : len(w) - n + 1 + i])
    return np.unique(h)


#: Makes a second hash, so that two of them tell sets apart beyond 2 ** 32 documents.
CHECK = 0x9FB21C651E98DF25


def set_hash(shingles: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit hash of a set, whatever the order of its members."""
    total = np.add.reduce(mix64(shingles ^ np.uint64(seed)), dtype=np.uint64) if len(shingles) else np.uint64(0)
    return int(mix64(np.array([total ^ np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])
