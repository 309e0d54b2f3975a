"""Pre-tokens of the byte-level BPE tokenizer, found for whole batches at once.

The split is that of the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Special-token strings in a text are cut out first, as the library does.
"""

from __future__ import annotations

import functools
import json
import sys

import numpy as np

from .textcols import code_points

SPECIAL = "<|endoftext|>"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.cache
def alphabet() -> dict[int, str]:
    """The letter that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the byte-level alphabet
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def check(path: str) -> None:
    """Raise ValueError unless the tokenizer file has the pre-tokens and the added token that this module cuts."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made.get("pre_tokenizer") or {}
    if made.get("normalizer") is not None or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False:
        raise ValueError(f"{path}: other pre-tokens than the byte-level ones")
    plain = [t for t in made.get("added_tokens", []) if not (t["content"] == SPECIAL and not any(t[k] for k in ("single_word", "lstrip", "rstrip")))]
    if plain:
        raise ValueError(f"{path}: added tokens {[t['content'] for t in plain]} are not cut")
    if (made.get("model") or {}).get("type") not in (None, "BPE"):
        raise ValueError(f"{path} is no BPE")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties the pattern names."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            low, high = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            table[low : high + 1] = kind
    return table


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens; they cover the texts, and none crosses a text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)  # a text begins here
    opens[offsets] = True
    start = opens.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    # the last white character before something else in the same text stands apart
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~opens[1:n]
    start[:n] |= last
    # a plain space there belongs to what follows
    joins = np.flatnonzero(last & (points == 32)) + 1
    start[joins] = False
    # contractions: an apostrophe that begins a pre-token, and the letters it takes
    marks = np.flatnonzero((points == 39) & start[:n])
    marks = marks[marks + 1 < n]
    marks = marks[~opens[marks + 1]]
    if len(marks):
        one = points[marks + 1]
        two = np.zeros(len(marks), np.uint32)
        room = marks + 2 < n
        room[room] &= ~opens[marks[room] + 2]
        two[room] = points[marks[room] + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[marks[single | double] + 1] = False
        start[marks[single] + 2] = True
        start[marks[double] + 3] = True
    cuts = np.flatnonzero(start)
    if cuts[-1] != n:
        cuts = np.append(cuts, n)
    return cuts[:-1], cuts[1:]


def cut_special(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Segments between special strings, the text each is of, and how many special strings each text has."""
    segments: list[str] = []
    owner: list[int] = []
    specials = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and SPECIAL in text:
            parts = text.split(SPECIAL)
            specials[i] = len(parts) - 1
            segments += parts
            owner += [i] * len(parts)
        else:
            segments.append(text or "")
            owner.append(i)
    return segments, np.asarray(owner, np.int64), specials


def split(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, pre-token starts and ends, and the segment number of each pre-token."""
    points, offsets = code_points(segments)
    starts, ends = pre_tokens(points, offsets)
    return points, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_of(points: np.ndarray, start: int, end: int) -> str:
    return points[start:end].tobytes().decode("utf-32-le", "surrogatepass")
