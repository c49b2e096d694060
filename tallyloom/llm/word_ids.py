"""Token ids of texts by way of their distinct words, without a Python object for each word.

A slice of texts is cut at single blanks by Arrow and its words are numbered; the ids of
each distinct word are worked out once, and the ids of the texts are gathered from them by
array operations.  Words that a slice holds twice or more are remembered for later slices,
up to ``most``: an Arrow array of words and one flat array of ids, a few bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Ids = tuple[np.ndarray, np.ndarray]


def numbered(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word, bounds of the rows) of lists of words."""
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gathered(ids: Ids, which: np.ndarray) -> Ids:
    """The ids of each entry in which, one after another, and where each begins and ends."""
    flat, offsets = ids
    sizes = np.diff(offsets)[which]
    out = offsets_of(sizes)
    return flat[np.repeat(offsets[which] - out[:-1], sizes) + np.arange(out[-1])], out


class WordIds:
    """Ids of words by ``learn``, which takes a list of distinct words and returns (flat ids, sizes)."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.words = pa.array([], pa.string())
        self.ids: Ids = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def table(self, words: pa.Array, counts: np.ndarray) -> Ids:
        """Ids of distinct words; counts says how often each occurs."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        flat, sizes = self.learn(words.take(pa.array(new)).to_pylist()) if len(new) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        base = len(self.words)
        place[new] = base + np.arange(len(new))
        known, begun = self.ids
        whole = np.concatenate([known, flat.astype(np.int32)]), np.concatenate([begun, begun[-1] + np.cumsum(sizes, dtype=np.int64)])
        room = self.most - base
        if room > 0 and len(new):
            often = np.flatnonzero(counts[new] >= 2)[:room]
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new[often])).cast(pa.string())])
            self.ids = gathered(whole, np.concatenate([np.arange(base), base + often]))
        return gathered(whole, place)
