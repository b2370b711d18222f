"""BPE as a tokenization automaton.

The automaton reads token sequences and accepts just those that BPE gives. It starts with one state that loops on every
base symbol. Each merge a b -> ab, in order, applies one gadget:

* every a-arc is redirected to a new state, a copy of its old target without the b-arc (after a bare `a`, `b` can't follow);
* beside each a-arc there is a new ab-arc to where the old target's b-arc led.

All arcs with one label lead to one state, so a state is stored as (copied state, missing label, time of creation): a row
differs from the row it was copied from in one cell, and from later merges in cells that follow from the left part of the
new label. A cell of the transition table is found by following these two links and kept once found.

Encoding runs a pre-split word's symbols through the table: from a position, the labels that match the text there (a trie) and that
the position's state allows lead on, and exactly one path covers the word. Decoding emits arc labels.

Null text: empty, no ids. Repeated rows are encoded one by one, ties don't matter. Empty table: no rows. A very long text is one row; its words
are listed whole, in bounded slices of the table. Letters, numbers, white space, NFC and lower case are those of the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm import splitter
from memloom.llm.common import lean, slices, small_batches, texts_of

def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Automaton:
    """Deterministic automaton over tokens, compiled from merges. Tokens are numbered as in the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        n = len(vocab)
        self.label = [""] * n
        for s, i in vocab.items():
            self.label[i] = s
        self.born = [0] * n  # time of the merge that makes a token, 0 for base symbols
        self.left = [-1] * n
        self.target = [0] * n  # the state that arcs with this label lead to
        self.copied, self.missing, self.made = [-1], [-1], [0]
        self.cells: dict[int, bool] = {}
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        made_of: set[str] = {a + b for a, b in merges}
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[int] = [-1]
        for s, i in vocab.items():
            if self.born[i] or s not in made_of:
                self._spell(s, i)
        self.width = n

    def _gadget(self, time: int, a: int, b: int, ab: int) -> None:
        if self.born[ab] or max(self.born[a], self.born[b]) >= time:
            raise ValueError(f"merge {time} is out of order or makes a token for a second time")
        old, follow = self.target[a], self.target[b]
        self.born[ab], self.left[ab], self.target[ab] = time, a, follow
        self.target[a] = len(self.copied)
        self.copied.append(old)
        self.missing.append(b)
        self.made.append(time)

    def _spell(self, s: str, token: int) -> None:
        at = 0
        for c in self.symbols(s):
            nxt = self.trie[at].get(c)
            if nxt is None:
                nxt = self.trie[at][c] = len(self.trie)
                self.trie.append({})
                self.token_at.append(-1)
            at = nxt
        self.token_at[at] = token

    end = "</w>"

    def symbols(self, s: str) -> list[str]:
        """A token's base symbols; the last one carries the word-end mark if the token does."""
        if self.end and s.endswith(self.end) and len(s) > len(self.end):
            s = s[: -len(self.end)]
            return [*s[:-1], s[-1] + self.end]
        return list(s)

    def allows(self, state: int, token: int) -> bool:
        """A cell of the table: has `state` an arc with this label?"""
        s, x = state, token
        while s:
            if self.born[x] >= self.made[s]:
                x = self.left[x]  # made after the state: beside the arc of its left part
            elif x == self.missing[s]:
                break
            else:
                s = self.copied[s]
        known = self.cells[state * self.width + token] = s == 0
        return known

    def encode(self, word: str) -> list[int]:
        """The ids of a word given in base characters, its last one marked as the word's end.

        Longest labels come first. One path at most leads to a position, so one that was left again is not tried anew.
        """
        sym = [*word[:-1], word[-1] + self.end]
        n = len(sym)
        trie, token_at, target, width = self.trie, self.token_at, self.target, self.width
        known, allows = self.cells.get, self.allows
        seen = bytearray(n + 1)
        ids: list[int] = []
        way: list[tuple[int, list[tuple[int, int]]]] = []
        i = s = 0
        while i < n:
            at, found = 0, []
            for j in range(i, n):
                at = trie[at].get(sym[j], -1)
                if at < 0:
                    break
                t = token_at[at]
                if t >= 0:
                    found.append((j + 1, t))
            while True:
                while found:
                    i, t = found.pop()
                    if seen[i]:
                        continue
                    cell = known(s * width + t)
                    if allows(s, t) if cell is None else cell:
                        break
                else:
                    if not way:
                        raise ValueError("a symbol is not in the vocabulary")
                    s, found = way.pop()
                    ids.pop()
                    continue
                break
            seen[i] = 1
            way.append((s, found))
            ids.append(t)
            s = target[t]
        return ids


#: Fixed value: the splitter of word-end BPE files, as the vocabularies' documentation gives it.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
#: Words kept with their codes in a worker, in two generations: words met again move to the young one, and the old one is dropped when it is full.
MEMORY = 300_000
#: Cells of the table kept.
CELLS = 1_000_000
#: Characters of text in an output batch.
SLICE = 2_000_000
_LOADED: dict[str, "WordBpe"] = {}


class WordBpe:
    """Normaliser, splitter, special strings and automaton of a word-end BPE file."""

    def __init__(self, path: str, kinds: splitter.Kinds):
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]) or model["end_of_word_suffix"] != Automaton.end:
            raise ValueError("a tokenizer of this kind is not covered")
        self.automaton = Automaton(dense(model["vocab"]), merges)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(SPLIT.format(letters=r"\p{L}", numbers=r"\p{N}", spaces=splitter.SPACE))
        # texts with a character that Python's tables may take otherwise go through the library's own normaliser and classes
        self.odd = re.compile(f"[{kinds.odd}]") if kinds.odd else None
        self.exact = regex.compile(SPLIT.format(letters=kinds.letters, numbers=kinds.numbers, spaces=kinds.spaces))
        self.turned = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.byte = byte_symbols()
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def _code(self, word: str) -> tuple[bytes, str]:
        if len(self.automaton.cells) > CELLS:
            self.automaton.cells.clear()
        ids = self.automaton.encode("".join([self.byte[b] for b in word.encode()]))
        return b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.automaton.label[i] for i in ids])

    def cut_words(self, part: str) -> list[str]:
        if part.isascii() or self.odd is None or self.odd.search("".join(set(part))) is None:
            return self.split.findall(splitter.lowered(part))
        return self.exact.findall(self.turned(part))

    def text(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text that their arc labels give, one blank between labels."""
        ids, said = [], []
        known = self.words
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
                said.append(part)
                continue
            words = self.cut_words(part)
            for w in words:
                got = known.get(w)
                if got is None:
                    if len(known) >= MEMORY // 2:
                        self.older, self.words = known, {}
                        known = self.words
                    got = known[w] = self.older.get(w) or self._code(w)
                ids.append(got[0])
                said.append(got[1])
        return b"".join(ids), " ".join(said)


def dense(vocab: dict[str, int]) -> dict[str, int]:
    """The vocabulary itself; its ids must run from 0 without a gap."""
    if sorted(vocab.values()) != list(range(len(vocab))):
        raise ValueError("ids must be dense")
    return vocab


def loaded(path: str, kinds: splitter.Kinds) -> WordBpe:
    """The automaton of a file, compiled once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path, kinds)
    return _LOADED[path]


def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE characters, so that what comes out of one stays small."""
    for b in rows:
        for x, y in slices(np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0)), SLICE):
            yield b.slice(x, y - x)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids` (array of int) and `decoded`. Null text: empty text, no ids. Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs, kinds = docs.drop("ids", "decoded"), splitter.kinds()
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, kinds)
        for b in cut(rows):
            got = [bpe.text(t) for t in texts_of(b)]
            ends = np.cumsum([0, *(len(g[0]) // 4 for g in got)])
            flat = pa.array(np.frombuffer(b"".join(g[0] for g in got), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array([g[1] for g in got], pa.string())], [*b.schema.names, "ids", "decoded"])

    return docs.mapInArrow(lean(run), schema)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of the same ids and decoded texts, without shipping them out of the workers. Null doc_id: kept."""
    small_batches(docs.sparkSession)
    kinds = splitter.kinds()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, kinds)
        for b in cut(rows):
            got = [bpe.text(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got]), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
