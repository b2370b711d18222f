"""Knowledge-base plans: chunks, search, listing, page text; and the stream's batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import chunker, lexical, search, vector
from memloom.plans.registry import query
from memloom.plans.views import TERMS, Tables
from memloom.sources import pages


@query(None)
def kb_chunks(t: Tables) -> DataFrame:
    """Sentence-aware chunks of all documents (a fold, held against plain Python in the tests)."""
    c = chunker.chunked(t.mem(), "id", "content")
    return c.select(F.concat(F.lit("kb_"), F.substring(F.md5(F.col("id").cast("string")), 1, 8)).alias("document_id"), "chunk_index", "content", F.length("content").alias("n_chars"))


_WIN = "win AS (SELECT id AS document_id, i::INT AS chunk_index, substr(content, (i * 450 + 1)::BIGINT, 500) AS content FROM (SELECT id, content, unnest(range(0, greatest(ceil((length(content) - 50) / 450e0), 1)::BIGINT)) AS i FROM mem WHERE length(content) > 0))"
_BM = (
    r"wt AS (SELECT document_id, chunk_index, regexp_extract_all(lower(content), '\p{L}+|\p{Nd}+') AS t FROM win), wf AS (SELECT document_id, chunk_index, len(t) AS dl, [len(list_filter(t, lambda x: x = 'elle')), len(list_filter(t, lambda x: x = 'ment')), len(list_filter(t, lambda x: x = 'the'))] AS f FROM wt), "
    "ws AS (SELECT count(*) AS n, avg(dl) AS a, [count(*) FILTER (f[1] > 0), count(*) FILTER (f[2] > 0), count(*) FILTER (f[3] > 0)] AS df FROM wf), wb AS (SELECT document_id, chunk_index, round("
    + " + ".join(f"ln(1e0 + (n - df[{k}] + 0.5e0) / (df[{k}] + 0.5e0)) * f[{k}] * 2.2e0 / (f[{k}] + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))" for k in (1, 2, 3))
    + ", 6) AS score FROM wf, ws WHERE f[1] + f[2] + f[3] > 0), wr AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id, chunk_index) AS rank FROM wb QUALIFY rank <= 10), "
    "lex AS (SELECT document_id, round(max(1e0 / rank), 6) AS score, array_to_string(list(chunk_index ORDER BY chunk_index), ',') AS chunks FROM wr GROUP BY document_id)"
)
_VEC = "nearest AS (SELECT id AS document_id, distance FROM dist ORDER BY distance, id LIMIT 10), vec AS (SELECT document_id, round(max(1 / (1 + distance)), 6) AS score FROM nearest GROUP BY document_id)"


def chunk_hits(t: Tables) -> DataFrame:
    w = chunker.windows(t.mem(), "id", "content").withColumn("key", F.struct("id", "chunk_index"))
    return lexical.bm25(w, "content", TERMS, key="key").select(F.col("key.id").alias("document_id"), F.col("key.chunk_index").alias("chunk_index"), "score")


@query(f"WITH {_WIN}, {_BM} SELECT document_id, score, chunks FROM lex ORDER BY score DESC, document_id LIMIT 5", "mem")
def kb_search_bm25(t: Tables) -> DataFrame:
    found = search.by_rank(chunk_hits(t), 5).orderBy(F.desc("score"), "document_id").limit(5)
    return found.select("document_id", "score", F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"))


def near(t: Tables) -> DataFrame:
    return vector.with_distance(t.vectors(), t.query_vector()).select(F.col("id").alias("document_id"), "distance")


@query(f"WITH {_VEC} SELECT document_id, score FROM vec ORDER BY score DESC, document_id LIMIT 5", "mem", "qvec", "dist")
def kb_search_vector(t: Tables) -> DataFrame:
    return search.by_vector(near(t), 5).orderBy(F.desc("score"), "document_id").limit(5)


@query(
    f"WITH {_WIN}, {_BM}, {_VEC} SELECT document_id, round(0.6e0 * coalesce(v, 0) + 0.4e0 * coalesce(b, 0), 6) AS score FROM (SELECT document_id, score / (SELECT max(score) FROM vec) AS v FROM vec) FULL JOIN (SELECT document_id, score / (SELECT max(score) FROM lex) AS b FROM lex) USING (document_id) ORDER BY score DESC, document_id LIMIT 5",
    "mem", "qvec", "dist",
)
def kb_search_hybrid(t: Tables) -> DataFrame:
    return search.fused(search.by_vector(near(t), 5), search.by_rank(chunk_hits(t), 5), 5)


@query(f"WITH {_WIN} SELECT document_id, count(*) AS chunks, min(substr(content, 1, 20)) AS first_words FROM win GROUP BY document_id", "mem")
def kb_list_docs(t: Tables) -> DataFrame:
    w = chunker.windows(t.mem(), "id", "content")
    return w.groupBy(F.col("id").alias("document_id")).agg(F.count("*").alias("chunks"), F.min(F.substring("content", 1, 20)).alias("first_words"))


_HTML = r"html"
for _p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->"):
    _HTML = f"regexp_replace({_HTML}, '{_p}', ' ', 'g')"
_HTML = f"regexp_replace({_HTML}, '<[^>]+>', chr(10), 'g')"
for _k, _v in pages.NAMED.items():
    _HTML = f"replace({_HTML}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_HTML} AS text FROM pages")
def src_html_text(t: Tables) -> DataFrame:
    return t.base("pages").select("page_id", pages.html_text("html").alias("text"))
