"""BM25 over tokenised facts, for one query or a table of queries."""

import math
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizer import tokens, tokens_udf
from ..schema import BUCKETS, SOURCE_CAP, STOP_DF_DIVISOR, STOP_DF_FLOOR


#: Rows of a table of query terms, up to which it is broadcast.
SMALL_QUERY = 200_000
#: Bytes, by Spark's estimate, up to which a table is dealt over all cores first.
SMALL_TABLE = 256 << 20


def tokenised(facts: DataFrame, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """(fact_id, tokens).  The default tokenizer is the full rule in Arrow
    batches; pass ``latin_tokens`` for Latin text to stay in built-ins."""
    return facts.select("fact_id", (tokenizer or tokens_udf())(F.col("text")).alias("tokens"))


def postings(tokenised_facts: DataFrame) -> DataFrame:
    """(term, fact_id, tf), tf at most 255."""
    rows = tokenised_facts.select("fact_id", F.explode("tokens").alias("term"))
    return rows.groupBy("term", "fact_id").agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("tf"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(batches):
    """Each text's terms with their counts, one pass and no shuffle."""
    for b in batches:
        ids, n, terms, counts = b.column(0), [], [], []
        for t in b.column(1).to_pylist():
            found = tokens(t)
            own = Counter(found)
            n.append(len(found))
            terms.append(list(own))
            counts.append([min(c, 255) for c in own.values()])
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], names=["fact_id", "n", "terms", "tf"])


def spread(facts: DataFrame) -> DataFrame:
    """A small table's rows dealt over all cores, as it comes in few row groups;
    a large one as it is."""
    size = int(str(facts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return facts.repartition(facts.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_TABLE else facts


def indexed(facts: DataFrame) -> DataFrame:
    """(fact_id, n, terms, tf): what a store keeps of each fact's text."""
    return facts.select("fact_id", "text").mapInArrow(counted, "fact_id long, n long, terms array<string>, tf array<int>")


def stored_postings(index: DataFrame) -> DataFrame:
    """(term, fact_id, tf, len, bucket) of ``indexed`` facts."""
    rows = index.select("fact_id", F.least("n", F.lit(65535)).cast("int").alias("len"), F.explode(F.arrays_zip("terms", "tf")).alias("x"))
    return rows.select(F.col("x.terms").alias("term"), "fact_id", F.col("x.tf").alias("tf"), "len", bucket(F.col("x.terms")).alias("bucket"))


def corpus_of(lengths: DataFrame) -> tuple[int, int]:
    """The numbers of facts and of tokens of (fact_id, n)."""
    r = lengths.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    return r["docs"], r["total"]


def bm25_stored(postings: DataFrame, corpus: tuple[int, int], terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``bm25_one`` over a store's postings: only the folders of the query's
    terms are read.  ``corpus`` is as ``corpus_of`` all stored facts."""
    wanted = list(dict.fromkeys(terms))
    rows = postings.where(F.col("bucket").isin(*[bucket_of(t) for t in wanted]) & F.col("term").isin(*wanted))
    n, total = corpus
    found = {r["term"]: r["count"] for r in rows.groupBy("term").count().collect()}  # a row a term
    df = {t: found.get(t, 0) for t in wanted}
    kept = without_stops(terms, df, n)
    if not kept:
        return postings.sparkSession.createDataFrame([], "query_id long, fact_id long, score double")
    own = list(dict.fromkeys(kept))
    tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(own)]
    rows = rows.where(F.col("term").isin(*own)).groupBy("fact_id").agg(F.max("len").alias("len"), *tf)
    score = F.lit(0.0)
    for t in kept:
        x = F.coalesce(F.col(f"tf{own.index(t)}"), F.lit(0))
        score = score + weighted(x, F.col("len"), n, df[t], total, k1, b)
    return rows.select(F.lit(0).cast("long").alias("query_id"), "fact_id", F.round(score, 10).alias("score"))


def bucket_of(term: str) -> int:
    n = xxhash.xxh64_intdigest(term.encode(), seed=42)  # as F.xxhash64 does
    return (n - (1 << 64) if n >> 63 else n) % BUCKETS


def without_stops(terms: list[str], df: dict[str, int], n: int) -> list[str]:
    """The terms that count, in order: those of most facts are left out, unless
    there are no others, when the rarest stays."""
    stop = {t for t in terms if df[t] > STOP_DF_FLOOR and df[t] * STOP_DF_DIVISOR > n}
    kept = [t for t in terms if t not in stop] or [min(terms, key=df.get)]
    return [t for t in kept if df[t]]


def weighted(tf: Column, length: Column, n: int, df: int, total: int, k1: float, b: float) -> Column:
    weight = math.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.lit(weight) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / (total / n)))


def doc_stats(tokenised_facts: DataFrame) -> DataFrame:
    """(fact_id, len, distinct): both at most 65535, no shuffle."""
    return tokenised_facts.select("fact_id", F.least(F.size("tokens"), F.lit(65535)).alias("len"), F.least(F.size(F.array_distinct("tokens")), F.lit(65535)).alias("distinct"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_frequencies(tokenised_facts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of the distinct ``terms``; 0 for those no fact has."""
    wanted = terms.select("term").distinct()
    rows = tokenised_facts.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi")
    return wanted.join(rows.groupBy("term").agg(F.count("*").alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def kept_terms(terms: DataFrame, frequencies: DataFrame, n: Column) -> DataFrame:
    """``terms`` (query_id, pos, term) with df, without those that are in most
    facts; a query of nothing else keeps the rarest, the first of equals."""
    t = terms.join(frequencies, "term").withColumn("stop", (F.col("df") > STOP_DF_FLOOR) & (F.col("df") * STOP_DF_DIVISOR > n))
    q = Window.partitionBy("query_id")
    t = t.withColumn("all_stop", F.min(F.col("stop").cast("int")).over(q)).withColumn("rarest", F.row_number().over(q.orderBy("df", "pos")))
    return t.where(~F.col("stop") | ((F.col("all_stop") == 1) & (F.col("rarest") == 1))).select("query_id", "pos", "term", "df")


def bm25(tokenised_facts: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.75, stop_terms: bool = True) -> DataFrame:
    """(query_id, fact_id, score) of every fact that has a query's term.

    ``terms`` is (query_id, pos, term), repeats counting again.  Statistics are
    those of all of ``tokenised_facts``: pass every fact that is still stored,
    and filter the result.  A score is summed in the order of the terms, so it
    does not depend on how rows were dealt out.
    """
    wanted = terms.select("term").distinct()
    lengths = tokenised_facts.select("fact_id", F.size("tokens").alias("n"), F.least(F.size("tokens"), F.lit(65535)).alias("len"), "tokens")
    # What leaves the scan is a row for each fact and term that a query asks for.
    rows = lengths.select("fact_id", "len", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    tf = rows.groupBy("term", "fact_id", "len").agg(F.least(F.count("*"), F.lit(255)).alias("tf"))
    return _scored(tf, lengths, terms, k1, b, stop_terms)


def bm25_of_postings(postings: DataFrame, lengths: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.75, stop_terms: bool = True) -> DataFrame:
    """``bm25`` over a store's postings and lengths (fact_id, n); no text and no
    list of tokens is read."""
    tf = postings.join(terms.select("term").distinct(), "term", "left_semi").select("term", "fact_id", "len", "tf")
    return _scored(tf, lengths, terms, k1, b, stop_terms)


def _scored(tf: DataFrame, lengths: DataFrame, terms: DataFrame, k1: float, b: float, stop_terms: bool) -> DataFrame:
    corpus = lengths.agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    wanted = terms.select("term").distinct()
    df = wanted.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    query = terms.crossJoin(F.broadcast(corpus))  # one row
    query = query.join(df, "term")
    if stop_terms:
        kept = kept_terms(terms.crossJoin(F.broadcast(corpus.select("docs"))), df, F.col("docs"))
        query = query.join(kept.select("query_id", "pos"), ["query_id", "pos"], "left_semi")
    if terms.limit(SMALL_QUERY + 1).count() <= SMALL_QUERY:
        query = F.broadcast(query)  # a frequent term's postings stay where they are
    part = idf(F.col("docs"), F.col("df")) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (F.col("total") / F.col("docs"))))
    parts = tf.join(query, "term").select("query_id", "fact_id", "pos", part.alias("part"))
    summed = F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "part"))), F.lit(0.0), lambda a, x: a + x["part"])
    return parts.groupBy("query_id", "fact_id").agg(F.round(summed, 10).alias("score"))


def bm25_one(tokenised_facts: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``bm25`` of one query, (query_id 0, fact_id, score), without a shuffle.

    One pass counts; what it brings back is a row of as many numbers as the
    query has terms.  Then a fact's score is an expression over its own tokens.
    """
    wanted = list(dict.fromkeys(terms))
    has = [F.count_if(F.array_contains("tokens", t)).alias(f"df{i}") for i, t in enumerate(wanted)]
    row = tokenised_facts.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total"), *has).first()
    n, df = row["docs"], {t: row[f"df{i}"] for i, t in enumerate(wanted)}
    kept = without_stops(terms, df, n)
    hits = F.filter("tokens", lambda x: x.isin(*kept)) if kept else F.array().cast("array<string>")
    rows = tokenised_facts.select("fact_id", F.least(F.size("tokens"), F.lit(65535)).alias("len"), hits.alias("hits")).where(F.size("hits") > 0)
    score = F.lit(0.0)

    def count(term):
        return F.least(F.size(F.filter("hits", lambda x: x == term)), F.lit(255))

    for t in kept:
        score = score + weighted(count(t), F.col("len"), n, df[t], row["total"], k1, b)
    return rows.select(F.lit(0).cast("long").alias("query_id"), "fact_id", F.round(score, 10).alias("score"))


def top_one(scored: DataFrame, k: int = SOURCE_CAP, score: str = "score") -> DataFrame:
    """``top`` of one query: each task keeps k, and only those meet."""
    best = scored.orderBy(F.desc(score), "fact_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "fact_id")))


def top(scored: DataFrame, k: int = SOURCE_CAP, score: str = "score") -> DataFrame:
    """The k best of each query with their ``rank`` from 1, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "fact_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
