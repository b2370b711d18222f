"""The pipeline against a brute-force version of its stages, each on the stage's own input."""

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from memloom.llm import quality_rules as q
from memloom.llm.common import stored, tokenizer_path
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_dedup import brute_components
from tests.llm.test_files import naive_repeat

SF = "/root/testdata/sf0.001"


def cut(rows, span=50):
    least = {}
    data = sorted((i, t.encode()) for i, t in rows)
    for i, b in data:
        for s in range(len(b) - span + 1):
            least.setdefault(b[s : s + span], i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if least[b[s : s + span]] < i:
                gone[s : s + span] = b"\1" * span
        out[i] = bytes(x for x, c in zip(b, gone, strict=True) if not c).decode(errors="ignore")
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, texts = docs.columns, [], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name != "bpe_automaton":
            assert docs.columns == columns
            texts.append({r.doc_id: r.text for r in docs.collect()})
        ids.append({r.doc_id for r in docs.collect()})
    raw = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()

    def keeps(t):
        x = q.Features(t or "")
        return not (x.n_words < 20 or 100 * naive_repeat(x.words) > 30 * x.n_words or any(r.rejects(x) for r in q.RULES))

    assert ids[0] == {i for i, t in raw if keeps(t)}
    assert ids[1] == {c for _, _, c in brute_components(list(texts[0].items()), 5, 80, 100)}
    assert texts[2] == cut(texts[1].items()) and ids[2] == ids[1]
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert ids[3] == ids[2] - {d for d, *_ in leaks(list(texts[2].items()), bench)}
    assert 0 < len(ids[3]) < len(ids[2]) < len(ids[0]) < len(raw)
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in docs.collect():
        assert r.ids == lib.encode(texts[3][r.doc_id], add_special_tokens=False).ids and r.decoded == lib.decode(r.ids, skip_special_tokens=False)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and got.count() > 50


def prose(seed, n=60):
    return " ".join(f"w{seed}x{k} and" for k in range(n))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null texts and ids, repeated rows, empty texts, and columns that have the names that stages would use."""
    rows = [(1, prose(1), "a"), (1, prose(1), "a"), (None, prose(2), "b"), (None, prose(3), "c"), (4, None, "d"), (5, "", "e"), (6, prose(6), None), (7, "too short", "f")]
    made = [(i, t, "en", s, None if t is None else len(t), "x", 5, True) for i, t, s in rows]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, rejected_by string, n_removed int, component_id boolean")
    bench = spark.createDataFrame([(1, prose(6, 40))], "item_id long, text string")
    bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "rejected_by", "n_removed", "component_id"]
        if name == "quality_rules":
            assert sorted((repr(r.doc_id), repr(r.source)) for r in docs.collect()) == [("1", "'a'"), ("1", "'a'"), ("6", "None"), ("None", "'b'"), ("None", "'c'")]
    got = docs.collect()
    assert sorted((repr(r.doc_id), r.source) for r in got) == [("1", "a"), ("None", "b"), ("None", "c")]
    assert {(r.rejected_by, r.n_removed, r.component_id) for r in got} == {("x", 5, True)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and last.count() == 3


def test_empty_table_stays_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some item of words here")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and got.count() == 0
