"""What the tokenizers library takes for letters, numbers and white space, found by asking it.

The library has Unicode tables of its own, older or newer than those of Python, of `regex` and of Java. So every splitter here works with classes
that are read from the library: blocks of 256 code points that behave alike take one question each, the others one for each character.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex

_SURROGATES = range(0xD800, 0xE000)
#: White space as Unicode's property White_Space has it.
SPACE = r"\t-\r\x85\p{Z}"


def _kinds(points: list[int], split: object) -> list[str]:
    """L, N, S or O of each character, by whether it stays with a letter, a digit or a sign before it."""
    chars = "".join(map(chr, points))
    if len(split("!" + chars)) == 1:
        return ["O"] * len(points)
    if len(split("a" + chars)) == 1:
        return ["L"] * len(points)
    text = "".join(f"a{c}\n1{c}\n!{c}\n" for c in chars)
    ends = np.zeros(len(text) + 1, np.int64)
    for _, (a, b) in split(text):
        ends[a] = b
    at = np.arange(len(points)) * 9
    stays = [(k, ends[at + 3 * n] == at + 3 * n + 2) for n, k in enumerate("LNO")]
    return [next((k for k, s in stays if s[i]), "S") for i in range(len(points))]


@functools.cache
def ranges() -> dict[str, list[tuple[int, int]]]:
    """First and last code points of the runs of letters (L), numbers (N) and white space (S)."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    kinds = np.full(0x110000, ord("O"), np.uint8)
    for a in range(0, 0x110000, 256):
        if a not in _SURROGATES:
            kinds[a : a + 256] = np.frombuffer("".join(_kinds(list(range(a, a + 256)), split)).encode(), np.uint8)
    cuts = np.r_[0, np.flatnonzero(np.diff(kinds)) + 1, len(kinds)]
    out: dict[str, list[tuple[int, int]]] = {"L": [], "N": [], "S": []}
    for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if kinds[x] != ord("O"):
            out[chr(kinds[x])].append((x, y - 1))
    return out


def packed() -> str:
    """The ranges as the kernel reads them."""
    return ";".join(",".join(f"{x:x}" for pair in ranges()[k] for x in pair) for k in "LNS")


def _class(pairs: list[tuple[int, int]]) -> str:
    """Ranges as the inside of a character class of a pattern."""
    return "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in pairs)


def _runs(points: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return [(int(r[0]), int(r[-1])) for r in np.split(points, cuts) if len(r)]


@dataclass(frozen=True)
class Kinds:
    """Insides of character classes: the library's letters, numbers and spaces, and the odd characters, which the library may take otherwise
    than Python does."""

    letters: str
    numbers: str
    spaces: str
    odd: str


@functools.cache
def kinds() -> Kinds:
    """What patterns need to cut as the library cuts. Few texts have an odd character; the others can be cut by Python's own tables.

    Odd are characters that `regex` puts into another class, that NFC or lower case turn into something else by themselves, and marks that
    came after Unicode 3.2, whose order among other marks one side may not know. All others are normalised alike by any version.
    """
    from tokenizers import normalizers

    own = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "S": regex.compile(rf"[{SPACE}]")}
    of = np.full(0x110000, 0, np.uint8)
    for code, k in enumerate("LNS", 1):
        for x, y in ranges()[k]:
            of[x : y + 1] = code
    turn = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
    odd = np.zeros(0x110000, bool)
    for a in range(0, 0x110000, 0x1000):
        points = [c for c in range(a, a + 0x1000) if c not in _SURROGATES and c != 1]
        chars = list(map(chr, points))
        theirs, ours = turn("\1".join(chars)).split("\1"), lowered("\1".join(chars)).split("\1")
        text = "".join(chars)
        at = np.zeros(len(points), np.uint8)
        for code, k in enumerate("LNS", 1):
            at[[m.start() for m in own[k].finditer(text)]] = code
        late = [unicodedata.category(c)[0] == "M" and unicodedata.ucd_3_2_0.category(c) == "Cn" for c in chars]
        odd[points] = (at != of[points]) | np.array([x != y for x, y in zip(theirs, ours, strict=True)]) | np.array(late)
    return Kinds(*(_class(ranges()[k]) for k in "LNS"), _class(_runs(np.flatnonzero(odd))))


def lowered(text: str) -> str:
    """NFC, then each character in lower case by itself (a final sigma is no exception)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def unpacked(cut: bytes) -> tuple[tuple[int, int], list[bytes], np.ndarray]:
    """A cut text: number and earlier size of the dictionary, its new words, and the word's number at each place of the text."""
    size = int.from_bytes(cut[12:16], "little")
    head = int.from_bytes(cut[:8], "little"), int.from_bytes(cut[8:12], "little")
    return head, cut[16 : 16 + size].split(b"\xff")[:-1], np.frombuffer(cut, "<u4", offset=16 + size)
