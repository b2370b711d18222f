r"""Chat formatting at token level.

A turn becomes: the reserved id of its role, the ids of its escaped text, the reserved id that ends a turn. Texts are encoded
by themselves, so that no piece spans a boundary, and reserved ids lie above the vocabulary, so that no text can make one.
In text form the reserved ids read `### User: `, `### Assistant: `, `### System: `, `### Other: `, `</role>` and `</turn>`;
where a text holds such a string, it gets one backslash more before it, which reading back takes off. A role other than the three
is written as `### Other: `, the role's name, `</role>`.

The loss mask marks the tokens of assistants' texts and nothing else. It is the running sum of +1 where such a text begins and
-1 where it ends, over the ids of a piece of a conversation.

Turns are encoded where they are read, spread evenly; a conversation's turns then come together sorted and pass through one
task as a stream of pieces of at most PIECE ids (whole turns), so that a conversation of any length needs bounded memory. Its
digest is a hash over all its text in order and therefore one task's work.

Null role: the empty name. Null text: empty. Null conv_id: a conversation of its own. Null turn: before the others. Equal turns:
by role, then by ids. Repeated rows are repeated turns. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.bpe_automaton import byte_symbols
from memloom.llm.common import lean, partitions

USER, ASSISTANT, SYSTEM, OTHER, END_ROLE, END_TURN = range(6)
SAID = ("### User: ", "### Assistant: ", "### System: ", "### Other: ", "</role>", "</turn>")
ROLES = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
NAMES = {v: k for k, v in ROLES.items()}
_ESCAPE = re.compile(r"(\\*)(" + "|".join(map(re.escape, SAID)) + ")")
PIECE = 1 << 20
TURN = "conv_id long, turn long, role string, ids binary"
FORMATTED = "conv_id long, first boolean, n_turns long, ids binary, mask binary"
_LOADED: dict[str, "Codec"] = {}


def escaped(text: str) -> str:
    """Each control string in the text, with the backslashes before it, gets one backslash more."""
    return _ESCAPE.sub(r"\\\1\2", text) if "###" in text or "</" in text else text


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1][1:] + m[2], text) if "###" in text or "</" in text else text


class Codec:
    """A byte-level tokenizers file with reserved ids above its vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["added_tokens"] = []  # a special string in a text is ordinary text
        self.library = Tokenizer.from_str(json.dumps(spec))
        vocab = self.library.get_vocab()
        self.base = max(vocab.values()) + 1
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes = [b""] * self.base
        for s, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes[i] for i in ids.tolist()]).decode()


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def assembled(c: Codec, roles: list[str], texts: list[str]) -> list[np.ndarray]:
    """The ids of each turn."""
    coded = c.encode([escaped(t) for t in texts])
    names = c.encode([escaped(r) if r not in ROLES else "" for r in roles])
    mark = [np.array([c.base + k], "<u4") for k in range(len(SAID))]
    return [np.concatenate([mark[ROLES[r]], ids, mark[END_TURN]] if r in ROLES else [mark[OTHER], name, mark[END_ROLE], ids, mark[END_TURN]]) for r, ids, name in zip(roles, coded, names, strict=True)]


def loss_mask(ids: np.ndarray, base: int) -> np.ndarray:
    """1 for each token of an assistant's text: the running sum of begins and ends."""
    step = np.zeros(len(ids) + 1, np.int32)
    begins = np.flatnonzero(ids == base + ASSISTANT)
    ends = np.flatnonzero(ids == base + END_TURN)
    step[begins + 1] += 1
    step[ends[np.searchsorted(ends, begins)]] -= 1
    return np.cumsum(step[:-1]).astype("u1")


def format_conversations(turns: DataFrame, path: str) -> DataFrame:
    """Conversations as pieces of ids and masks; each partition holds whole conversations, their pieces in order."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in rows:
            roles, texts = ([x or "" for x in b.column(k).to_pylist()] for k in ("role", "text"))
            ids = assembled(c, roles, texts)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(roles), pa.array([x.tobytes() for x in ids], pa.binary())], [x.split()[0] for x in TURN.split(", ")])

    def assemble(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, fresh, held, size = codec(path), (), True, [], 0

        def piece() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([fresh]), pa.array([len(held)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([loss_mask(ids, c.base).tobytes()], pa.binary())], [x.split()[0] for x in FORMATTED.split(", ")])

        for b in rows:
            for conv, ids in zip(b.column("conv_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if held and (conv != now[0] or size >= 4 * PIECE):
                    yield piece()
                    fresh, held, size = conv != now[0], [], 0
                now = (conv,)
                held.append(ids)
                size += len(ids)
        if held:
            yield piece()

    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    coded = turns.mapInArrow(lean(encode), TURN).repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return coded.mapInArrow(lean(assemble), FORMATTED)


def turns_of(c: Codec, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
    """Role, text, text under the mask and formatted characters of each turn of a piece, from its ids alone."""
    begin = 0
    for end in np.flatnonzero(ids == c.base + END_TURN).tolist():
        kind, at = int(ids[begin]) - c.base, begin + 1
        if kind == OTHER:
            stop = at + int(np.flatnonzero(ids[at:end] == c.base + END_ROLE)[0])
            named = c.decode(ids[at:stop])
            role, at, chars = unescaped(named), stop + 1, len(SAID[OTHER]) + len(named) + len(SAID[END_ROLE])
        else:
            role, chars = NAMES[kind], len(SAID[kind])
        under = ids[begin : end + 1][mask[begin : end + 1].astype(bool)]
        said = c.decode(ids[at:end])
        text = unescaped(said)
        yield role, text, text if len(under) == end - at and len(under) else unescaped(c.decode(under)), chars + len(said) + len(SAID[END_TURN])
        begin = end + 1


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Each conversation's counts and digests, read from the formatter's output."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, own, done = codec(path), None, []
        for b in rows:
            for r in b.to_pylist():
                if r["first"]:
                    if own is not None:
                        done.append(own)
                    own = {"conv_id": r["conv_id"], "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, text, under, chars in turns_of(c, np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["mask"], "u1")):
                    own["n_turns"] += 1
                    own["chars"] += chars
                    own["turns"].update(f"{role}\n{text}\n".encode())
                    own["loss_chars"] += len(under)
                    own["loss"].update(under.encode())
            if len(done) >= 5000:
                yield _digests(done)
                done = []
        if own is not None:
            done.append(own)
        yield _digests(done)

    return formatted.mapInArrow(lean(read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(done: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x["conv_id"] for x in done], pa.int64()), pa.array([x["n_turns"] for x in done], pa.int64()), pa.array([x["turns"].hexdigest() for x in done], pa.string()), pa.array([x["loss_chars"] for x in done], pa.int64()), pa.array([x["loss"].hexdigest() for x in done], pa.string()), pa.array([x["chars"] for x in done], pa.int64())],
        ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )
