"""Keys of 23-bit words by the perfect binary Golay code.

Every word lies within three bits of exactly one of the 4,096 codewords. The keys of a word are the codewords within
four bits of it: one for words within two bits of a codeword, six for others. Two words that differ in at most two bits
share a key: the word between them is within one bit of both, so its codeword is within four bits of both.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def remainder(word: int) -> int:
    """11-bit syndrome: word modulo the generator."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def patterns() -> np.ndarray:
    """For each syndrome, the error patterns of weight four or less; -1 fills its row of six."""
    single = [remainder(1 << b) for b in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]

    def grow(start: int, left: int, syndrome: int, word: int) -> None:
        found[syndrome].append(word)
        if left:
            for b in range(start, 23):
                grow(b + 1, left - 1, syndrome ^ single[b], word | 1 << b)

    grow(0, 4, 0, 0)
    # The leader comes first; patterns of four bits join it only where it has three.
    out = np.full((2048, 6), -1, np.int64)
    for s, words in enumerate(found):
        words = sorted(words, key=lambda w: (w.bit_count(), w))
        out[s, : len(words)] = words
    return out


@cache
def syndromes() -> np.ndarray:
    """Syndromes of the low 12 and of the high 11 bits, to be combined by exclusive or."""
    return np.array([[remainder(w) for w in range(4096)], [remainder(w << 12) if w < 2048 else 0 for w in range(4096)]], np.int64)


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword numbers (12 bits) of n words of 23 bits; -1 where there are fewer."""
    table = syndromes()
    errors = patterns()[table[0][words & 4095] ^ table[1][words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)
