"""Words of whole texts, interned as numbers.

A word is a stretch of bytes other than space and U+0009 to U+000D, which is what
``bytes.split`` gives.
"""

from __future__ import annotations

import numpy as np


class _Numbers(dict):
    """Numbers its keys from 0 in the order in which they are asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def interned(body: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and for each the number of its first like."""
    words = body.split()
    return words, np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))
