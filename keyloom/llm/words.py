"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the rolling combination.
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps silently on uint64 arrays)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array, raw: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Word hashes of all texts in a row, and the first position of each text (and one past the last).

    Words are runs of letters, digits and underscores, in lower case.  With
    ``raw`` also the words themselves come back.
    """
    import xxhash

    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    parts = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{N}\p{M}_]+", " "), " "), " ")
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(parts)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    codes = coded.indices.to_numpy()
    hashes = known[codes] if len(codes) else np.zeros(0, np.uint64)
    edges = np.concatenate([[0], np.cumsum(n)])
    blank = coded.dictionary.index("").as_py()
    if blank >= 0:  # a text without words splits into one empty piece
        keep = codes != blank
        edges = np.concatenate([[0], np.cumsum(keep)])[edges]
        hashes = hashes[keep]
        flat = flat.filter(pa.array(keep)) if raw else flat
    return hashes, edges, (flat if raw else None)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; as many as there are runs (texts not yet parted)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * STEP + hashes[i : len(out) + i]
    return mix(out)


def shingle_sets(hashes: np.ndarray, edges: np.ndarray, n: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct shingles, ascending, and how often each stands there.

    A text of fewer than n words has one shingle, all its words; one without words none.
    """
    runs, out = rolled(hashes, n), []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        if z - a >= n:
            out.append(np.unique(runs[a : z - n + 1], return_counts=True))
        elif z > a:
            out.append((rolled(hashes[a:z], int(z - a)), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out
