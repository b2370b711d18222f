"""Chat formatting, token counts, and the BPE automaton against the library."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm import bpe_automaton, chat, splitter, token_counts
from memloom.llm.common import tokenizer_path
from memloom.llm.queries import op2_chat_formatting
from memloom.llm.token_files import cut_texts

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n  x", "aaaa aaaaaaaaaaa", "Hello ΣΑΣ İstanbul don't we'll 123 <|endoftext|>x<|startoftext|> \x1c\x85　é ﬁ ☃☃ !!??", "a" * 3000, "漢字かな" * 50, " " * 2000 + "x" * 5000, "x<|endoftext|><|endoftext|>\n", "\r\n\t\x0b\x0c \xa0y", "\x00\x00z"]


def odd_texts(n=200):
    r = random.Random(3)
    return ODD + ["".join(r.choice("aabcdethiosn 'SŚé漢!1\n ​İ") for _ in range(r.randint(0, 200))) for _ in range(n)]


def rows(spark, texts):
    """With an extra column that clashes, and the first row twice."""
    data = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[0]], "doc_id long, text string, n_tokens string")


def test_counts_are_the_librarys(spark):
    texts = odd_texts()
    lib = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(rows(spark, texts), BYTES, limit=50).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got)) == sorted([*want, want[0]])


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(rows(spark, [""]).where("false"), BYTES).count() == 0


def test_splitter_is_the_librarys(spark):
    lib = Tokenizer.from_file(BYTES)
    texts = [t for t in odd_texts(2000) if t and "<|" not in t]
    texts += [a + c + b for c in (" ", "  ", "\n", "\t ", "\u3000", "'", "''", "'s", "'re", "'ll'", "'v", " 's", "1'd") for a in ("", "a", "1", "!", " ") for b in ("", "a", "1", "!", " ", "\n")]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("cut", cut_texts(spark, BYTES, F.col("text"))).collect()
    dictionaries = {}
    for r in got:
        (d, before), fresh, places = splitter.unpacked(bytes(r.cut))
        words = dictionaries.setdefault(d, [])
        assert len(words) == before
        words += fresh
        assert [words[k].decode() for k in places] == [r.text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(r.text)]


def test_kinds_are_the_librarys_for_every_character():
    """Against one question for each code point."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    kinds = np.full(0x110000, "O")
    for k, pairs in splitter.ranges().items():
        for x, y in pairs:
            kinds[x : y + 1] = k
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 20_000):
        own = points[a : a + 20_000]
        text = "".join(f"a{chr(c)}\n1{chr(c)}\n!{chr(c)}\n" for c in own)
        ends = dict(x for _, x in split(text))
        for i, c in enumerate(own):
            stays = [k for n, k in enumerate("LNO") if ends.get(9 * i + 3 * n) == 9 * i + 3 * n + 2]
            assert kinds[c] == (stays or ["S"])[0], hex(c)


def test_automaton_is_the_library(spark):
    texts = odd_texts()
    lib = Tokenizer.from_file(WORDS)
    full = {r.doc_id: r for r in bpe_automaton.encode_documents(rows(spark, texts), WORDS).collect()}
    digests = {r.doc_id: r for r in bpe_automaton.digest_documents(rows(spark, texts), WORDS).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        assert (full[i].ids, full[i].decoded) == (ids, said)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert tuple(digests[i]) == (i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_automaton_for_every_character(spark):
    """Ids and text of words around each code point, assigned or not, and of sequences of marks, against the library."""
    lib = Tokenizer.from_file(WORDS)
    bpe = bpe_automaton.WordBpe(WORDS, splitter.kinds())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(7)
    marks = [chr(c) for c in points if unicodedata.combining(chr(c))] + ["e", "A", "ộ", "ᄀ", "ᅡ", "ᆨ", "Å"]
    texts = ["".join(f"A{chr(c)}b {chr(c)}1\n" for c in points[a : a + 50]) for a in range(0, len(points), 50)]
    texts += ["".join(r.choices(marks, k=r.randint(2, 6))) for _ in range(20_000)]
    for a in range(0, len(texts), 2000):
        part = texts[a : a + 2000]
        for t, e in zip(part, lib.encode_batch(part, add_special_tokens=False), strict=True):
            ids, said = bpe.text(t)
            assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
            assert said == lib.decode(e.ids, skip_special_tokens=False)


def test_automaton_on_long_words():
    """Paths that turn back: long runs of few letters, against the library."""
    lib, bpe, r = Tokenizer.from_file(WORDS), bpe_automaton.WordBpe(WORDS, splitter.kinds()), random.Random(11)
    words = ["a" * 5000, "ab" * 2500, "the" * 1000, *("".join(r.choices("aehinrst", k=r.randint(1, 200))) for _ in range(2000))]
    for w, e in zip(words, lib.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(bpe.text(w)[0], "<u4").tolist() == e.ids, w


def test_encoding_of_odd_tables(spark):
    """An empty table, null ids, and columns that clash with those that are added."""
    df = spark.createDataFrame([(None, "A b", "x", 1), (None, "A b", "x", 1)], "doc_id long, text string, ids string, decoded int")
    got = bpe_automaton.encode_documents(df, WORDS)
    lib = Tokenizer.from_file(WORDS)
    assert [r.ids for r in got.collect()] == [lib.encode("A b", add_special_tokens=False).ids] * 2 and got.columns == ["doc_id", "text", "ids", "decoded"]
    assert [r.doc_id for r in bpe_automaton.digest_documents(df, WORDS).collect()] == [None, None]
    assert bpe_automaton.encode_documents(df.where("false"), WORDS).count() == 0 == bpe_automaton.digest_documents(df.where("false"), WORDS).count()
    assert [r.doc_id for r in token_counts.count_tokens(df, BYTES).collect()] == [None, None]


def test_automaton_on_small_merges():
    """Against merging rule by rule, on every short string."""
    from itertools import product

    def apply(word, merges):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (a, b):
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "b</w>"), ("aa", "aa"), ("ba", "a</w>")]
    vocab = {s: i for i, s in enumerate(["a", "b", "a</w>", "b</w>", *(x + y for x, y in merges)])}
    m = bpe_automaton.Automaton(vocab, merges)
    for n in range(1, 9):
        for w in map("".join, product("ab", repeat=n)):
            assert [m.label[t] for t in m.encode(w)] == apply(w, merges)
    with pytest.raises(ValueError):
        bpe_automaton.Automaton({"a": 0, "b": 1, "ab": 2}, [("a", "b"), ("a", "b")])


def digests(turns):
    s, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in turns:
        s.update(f"{role or ''}\n{text or ''}\n".encode())
        loss.update((text or "").encode() if role == "assistant" else b"")
    return len(turns), s.hexdigest(), sum(len(t or "") for r, t in turns if r == "assistant"), loss.hexdigest()


@pytest.mark.parametrize("piece", [4, chat.PIECE])
def test_chat_round_trip(spark, piece, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", piece)
    r, conv = random.Random(5), {}
    bits = [*chat.SAID, "\\", "\\\\", "### ", "</turn", "<|endoftext|>", "é漢", "a b", "\n", None]
    for c in range(40):
        conv[c] = [(r.choice(["user", "assistant", "system", "tool", "", None, "### User: "]), None if r.random() < 0.1 else "".join(x for x in r.choices(bits, k=6) if x)) for _ in range(r.randint(1, 12))]
    turns = spark.createDataFrame([(c, i, role, text, 1) for c, t in conv.items() for i, (role, text) in enumerate(t)], "conv_id long, turn int, role string, text string, ids int")
    got = {x.conv_id: tuple(x)[1:6] for x in chat.read_back(chat.format_conversations(turns, BYTES), BYTES).collect()}
    assert got == {c: (*digests(t), formatted(t)) for c, t in conv.items()}


def formatted(turns):
    """Code points of a conversation in text form: a role's mark, a named role and its end, the escaped text, a turn's end."""
    marks = {"user": "### User: ", "assistant": "### Assistant: ", "system": "### System: "}
    heads = [marks.get(role) or "### Other: " + chat.escaped(role or "") + "</role>" for role, _ in turns]
    return sum(len(h) + len(chat.escaped(text or "")) + len("</turn>") for h, (_, text) in zip(heads, turns, strict=True))


def test_chat_of_odd_turns(spark):
    """Null conv_id, repeated rows, equal turns and null turns."""
    turns = [(None, 0, "user", "who"), (None, 1, "assistant", "me"), (1, 0, "user", "same"), (1, 0, "user", "same"), (2, None, "assistant", "first"), (2, 0, "user", "then"), (3, 5, "user", "b"), (3, 5, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3)
    got = {x.conv_id: tuple(x)[1:6] for x in chat.read_back(chat.format_conversations(df, BYTES), BYTES).collect()}
    conv = {None: [("user", "who"), ("assistant", "me")], 1: [("user", "same")] * 2, 2: [("assistant", "first"), ("user", "then")]}
    assert {k: got[k] for k in conv} == {c: (*digests(t), formatted(t)) for c, t in conv.items()}
    assert got[3] in [(*digests(t), formatted(t)) for t in ([("user", "b"), ("assistant", "a")], [("assistant", "a"), ("user", "b")])] and len(got) == 4


def test_counts_of_null_ids_and_long_texts(spark):
    lib = Tokenizer.from_file(BYTES)
    texts = ["one two", None, " ".join(f"word{k}" for k in range(60_000))]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2])], "doc_id long, text string")
    want = sorted([(None, 7, len(lib.encode(texts[0], add_special_tokens=False).ids), False), (None, 0, 0, False), *[(7, len(texts[2]), len(lib.encode(texts[2], add_special_tokens=False).ids), True)] * 2], key=repr)
    assert sorted(map(tuple, token_counts.count_tokens(df, BYTES).collect()), key=repr) == want


def test_chat_escapes():
    for t in ("", "\\### Assistant: </turn> ok", "\\\\</turn>\\", "### User: ### User: ", "plain"):
        e = chat.escaped(t)
        assert chat.unescaped(e) == t
        assert not any(e.startswith(s) or any(e[i - 1] != "\\" for i in range(1, len(e)) if e.startswith(s, i)) for s in chat.SAID)


def test_chat_of_an_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns, BYTES), BYTES).count() == 0


def test_op2_query(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    conv = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for c, role, text in duckdb.sql(f"select conv_id, role, text from '{d}/conversations.parquet' order by conv_id, turn").fetchall():
        conv.setdefault(c, []).append((role, text))
    assert {x.conv_id: tuple(x)[1:5] for x in op2_chat_formatting(spark, d).collect()} == {c: digests(t) for c, t in conv.items()}
