"""Pre-tokens of byte-level BPE and the merges inside them, for many texts at a time.

The pattern of the public tokenizers splits a text by character class. Here the
same cuts are found with array operations on the classes of all characters of a
batch, which is many times faster than running the pattern.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken

#: Character classes of the pattern.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: What may follow an apostrophe to form a token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters whose classes and cuts are held at a time; a longer text is held whole.
PIECE = 1 << 18


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, as the pattern's own classes say."""
    out = np.zeros(0x110000, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    where = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"),
                          (SPACE, r"\p{White_Space}+")):
        for match in regex.finditer(pattern, text):
            out[where[match.start():match.end()]] = kind
    return out


def cuts(codes: np.ndarray, kinds: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for the characters of several texts end to end.

    ``text_starts`` are the (sorted) positions at which non-empty texts start.
    """
    n = len(codes)
    start = np.zeros(n + 1, bool)
    fresh = np.zeros(n + 1, bool)
    fresh[text_starts] = True
    fresh[n] = True
    start[0] = start[n] = True
    start[1:n] = (kinds[1:] != kinds[:-1]) | fresh[1:n]
    # of white space before something else, the last character is cut off; a blank
    # then belongs to what follows, any other stands alone
    edge = np.flatnonzero(start[1:n] & ~fresh[1:n] & (kinds[:-1] == SPACE)) + 1
    start[edge - 1] = True
    start[edge[codes[edge - 1] == 32]] = False
    # an apostrophe with certain letters, when a token starts at it
    mark = np.flatnonzero((codes == 39) & start[:n])
    for tail in CONTRACTIONS:
        k = len(tail)
        mark = mark[mark + 1 < n]
        fits = mark[mark + k < n]
        for i, letter in enumerate(tail):
            fits = fits[(codes[fits + 1 + i] == ord(letter)) & ~fresh[fits + 1 + i]]
        start[fits + 1] = False
        start[fits + 1 + k] = True
    return np.flatnonzero(start[:n])


def pretokenize(texts: list[str | None], table: np.ndarray,
                piece: int = PIECE) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts as one dictionary-coded array, and how many each text has.

    Texts are cut up piece by piece, as the arrays over all characters are many times their size.
    """
    found, counts = [], []
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= piece or i == len(texts) - 1:
            tokens, per_text = _pretokenize(texts[start:i + 1], table)
            found.append(tokens)
            counts.append(per_text)
            start, size = i + 1, 0
    if not found:
        return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(0, np.int64)
    # one dictionary, in order of first appearance
    whole = pa.chunked_array(found).unify_dictionaries()
    coded = pa.concat_arrays(whole.chunks)
    return coded, np.concatenate(counts)


def _pretokenize(texts: list[str | None], table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    parts = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(p) // 4 for p in parts], np.int64)
    codes = np.frombuffer(b"".join(parts), np.uint32)
    del parts
    begins = np.cumsum(lengths) - lengths
    if not len(codes):
        return pa.array([], pa.large_binary()).dictionary_encode(), lengths
    found = cuts(codes, table[codes], begins[lengths > 0])
    size = np.ones(len(codes), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        size += codes >= least
    data = "".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
    offsets = np.append(0, np.cumsum(np.add.reduceat(size, found, dtype=np.int64)))
    del size
    tokens = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    per_text = (np.searchsorted(found, begins + lengths) - np.searchsorted(found, begins))
    return tokens.dictionary_encode(), per_text


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merger(ranks: dict[bytes, int]):
    """A function from the bytes of one pre-token to its ids."""
    coder = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return coder._core_bpe.encode_single_piece if hasattr(
        coder, "_core_bpe") else coder._encode_single_piece


def flatten(lists: list[list[int]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and where each starts (one more at the end)."""
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))))
    flat = np.fromiter((i for ids in lists for i in ids), dtype, int(bounds[-1]))
    return flat, bounds


def gather(flat: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``index`` of ``flat`` end to end, and each run's length."""
    sizes = np.diff(bounds)[index]
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return flat[place + np.repeat(bounds[:-1][index], sizes)], sizes
