"""Tokens and BM25 for a known set of query terms.

Only the query's terms matter, so a document is reduced to its length and the terms' counts where it is read; neither tokens nor texts
are shuffled. These narrow rows pass one exchange, which the plan reuses for the corpus statistics (one row) and for the scores, so that texts
are read and cut once. `postings` builds the inverted index for stores that serve many queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: A CJK character, a run of other letters, or a run of digits.
TOKEN = r"[a-zA-Z[\p{L}&&[^一-鿿]]]++|[一-鿿]|\p{Nd}++"


#: The same in the dialect of `regex`, for questions.
QUERY_TOKEN = r"(?V1)[\p{L}--[一-鿿]]+|[一-鿿]|\p{Nd}+"


def tokens(text: Column | str) -> Column:
    """Tokens of a text as an array; null text gives none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is(term: str):
    return lambda x: x == term


def term_counts(df: DataFrame, text: str, terms: tuple[str, ...], key: str = "id") -> DataFrame:
    """(key, dl, f): length in tokens, and how often each term occurs."""
    t = df.select(key, tokens(F.lower(text)).alias("t"))
    return t.select(key, F.size("t").alias("dl"), F.array(*(F.size(F.filter("t", _is(w))) for w in terms)).alias("f"))


def bm25(df: DataFrame, text: str, terms: tuple[str, ...], key: str = "id", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of documents with a term: idf = ln(1 + (N - df + .5) / (df + .5)); the score to six digits."""
    tf = term_counts(df, text, terms, key).repartition(key)
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("a"), *(F.sum((F.col("f")[k] > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))))
    parts = [F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)) * F.col("f")[k] * (k1 + 1) / (F.col("f")[k] + k1 * ((1 - b) + b * F.col("dl") / F.col("a"))) for k in range(len(terms))]
    # the choice of rows with a term refers to the statistics, else it would move below the exchange and part the two uses of it
    score = F.when((F.col("n") > 0) & F.exists("f", lambda x: x > 0), F.round(sum(parts[1:], parts[0]), 6))
    return tf.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).where("score IS NOT NULL")  # one row


def postings(df: DataFrame, text: str, key: str = "id") -> DataFrame:
    """The inverted index (term, key, tf)."""
    return df.select(key, F.explode(tokens(F.lower(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
