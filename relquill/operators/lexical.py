"""Lexical scoring: BM25, TF and IDF cosine, hashed TF, overlap. Query terms alone are shuffled, but for hashed TF, whose norms need every term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relquill.functions.text import tokens
from relquill.sources.tables import materialise, parts


def postings(docs: DataFrame, id_col: str, toks: Column) -> DataFrame:
    """(id, tok, tf, dl): counts of each token of each document, with the document's length in tokens."""
    split = docs.select(F.col(id_col).alias("cand"), toks.alias("ts"))
    return split.select("cand", F.size("ts").alias("dl"), F.explode("ts").alias("tok")).groupBy("cand", "dl", "tok").agg(F.count("*").alias("tf"))


#: Query terms that are broadcast to the postings, at most; beyond that they are shuffled.
BROADCAST_TERMS = 1_000_000


def terms(queries: DataFrame, toks: Column | None = None) -> DataFrame:
    """(qid, tok, qtf) of the queries (qid, text)."""
    return queries.select("qid", F.explode(tokens("text") if toks is None else toks).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qtf"))


#: Bytes of texts that are broadcast, at most.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, most: int = BROADCAST_TERMS, size: Column | None = None) -> DataFrame:
    """``df``, broadcast if it has ``most`` rows or fewer and, with the ``size`` of a row in bytes, at most BROADCAST_BYTES."""
    if size is not None:
        held = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        return F.broadcast(df) if held["n"] <= most and held["bytes"] <= BROADCAST_BYTES else df
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def square_norm(ts: Column) -> Column:
    """Sum of the squared counts of an array's tokens, from its sorted runs; no token leaves its row."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, tok: Column) -> Column:
        run = F.when(s["last"] == tok, s["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(tok.alias("last"), (run + 1).alias("run"), (s["total"] + 2 * run + 1).alias("total"))  # (r + 1)^2 - r^2

    return F.aggregate(F.sort_array(ts), zero, step)["total"]


def query_postings(queries: DataFrame, docs: DataFrame, norms: bool = False) -> DataFrame:
    """(cand, dl, tok, tf) of the tokens that some query has, and for each document a row with a null token; ids are unique.

    Written once: the texts are read and split a single time, whatever is computed from the postings. With ``norms`` also
    ``square``, the squared length of the document's counts of all its tokens.
    """
    wanted = bounded(terms(queries).select("tok").distinct().withColumn("known", F.lit(True)))
    own = ["cand", "dl"] + ["square"] * norms
    # dealt by document before they are split, so that the counts of a text need no other shuffle
    split = docs.repartition(parts(docs), "cand").select("cand", tokens("text").alias("ts")).withColumn("dl", F.size("ts"))
    split = split.withColumn("square", square_norm(F.col("ts"))) if norms else split
    split = split.select(*own, F.explode(F.concat(F.array(F.lit(None).cast("string")), "ts")).alias("tok"))
    kept = split.join(wanted, "tok", "left").where("tok IS NULL OR known")
    return materialise(kept.groupBy(*own, "tok").agg(F.count("*").alias("tf")), "postings")


#: Pairs of query and document that one task adds up, about.
TASK_PAIRS = 2_000_000


def dealt(held: DataFrame, queries: DataFrame) -> DataFrame:
    """The tokens of ``query_postings`` dealt by document, so that the products of a pair meet in one task, in as many partitions as the
    pairs of ``queries`` and documents need: their number is stated, as that of the postings doesn't tell what they grow to.
    """
    pairs = held.where("tok IS NULL").count() * queries.count()
    n = max(held.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))
    return held.where("tok IS NOT NULL").repartition(n, "cand")


#: Weights of a query's terms that are broadcast to the postings, at most.
BROADCAST_WEIGHTS = 1_000_000


def bm25(queries: DataFrame, docs: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, postings: DataFrame | None = None, shared: bool = False) -> DataFrame:
    """(qid, cand, score) over all ``docs`` (cand, text) for ``queries`` (qid, text); a repeated query token counts again.

    With ``shared`` also the number of distinct tokens in common, as in ``overlap``.
    """
    held = query_postings(queries, docs) if postings is None else postings
    size = held.where("tok IS NULL").agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))  # one row
    df = held.where("tok IS NOT NULL").groupBy("tok").agg(F.count("*").alias("df"))
    weight = df.join(F.broadcast(size)).select("tok", "avgdl", bm25_idf().alias("idf"))
    weighted = bounded(terms(queries).join(weight, "tok").select("qid", "tok", "avgdl", (F.col("qtf") * F.col("idf")).alias("w")), BROADCAST_WEIGHTS)
    # dealt by document, the products of a pair meet in one task: they are added up without another shuffle
    return dealt(held, queries).join(weighted, "tok").groupBy("qid", "cand").agg(F.sum(bm25_part(k1, b)).alias("score"), *[F.count("*").alias("shared")] * shared)


def bm25_idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25_part(k1: float, b: float) -> Column:
    return F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25_in_groups(queries: DataFrame, postings: DataFrame, docs: DataFrame, scope: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, cand, score) with numbers of documents and lengths of each query's groups alone.

    ``scope``: qid, grp; ``docs``: cand, grp, of which a document has one. Counts are kept by group and added up by query; the
    weights of a query's terms in each of its groups meet the postings like those of ``bm25``.
    """
    held = materialise(postings.join(docs.select("cand", "grp").where("grp IS NOT NULL"), "cand"), "grouped")
    tf, scope = held.where("tok IS NOT NULL"), scope.select("qid", "grp").distinct()
    by_group = held.where("tok IS NULL").groupBy("grp").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
    size = scope.join(bounded(by_group), "grp").groupBy("qid").agg(F.sum("n").alias("n"), F.coalesce(F.nullif(F.sum("dl") / F.sum("n"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    seen = tf.groupBy("grp", "tok").agg(F.count("*").alias("df"))
    own = materialise(terms(queries).join(scope, "qid").join(seen, ["grp", "tok"]), "terms")  # a row for each query, group and token that it has there
    weight = own.groupBy("qid", "tok").agg(F.sum("df").alias("df")).join(size, "qid").select("qid", "tok", "avgdl", bm25_idf().alias("idf"))
    weighted = own.select("qid", "grp", "tok", "qtf").join(weight, ["qid", "tok"]).select("qid", "grp", "tok", "avgdl", (F.col("qtf") * F.col("idf")).alias("w"))
    return dealt(held, queries).join(bounded(weighted, BROADCAST_WEIGHTS), ["grp", "tok"]).groupBy("qid", "cand").agg(F.sum(bm25_part(k1, b)).alias("score"))


def pooled(scores: DataFrame, pool: DataFrame) -> DataFrame:
    """``scores`` of each candidate of ``pool`` (qid, cand); one that shares no token with its query, or has no text, scores 0."""
    return pool.select("qid", "cand").join(scores, ["qid", "cand"], "left").na.fill(0.0, ["score"])


def text_or_path(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """(cand, text): a node's record text, or the tokens of its path where it has none. ``nodes``: cand, path; ``records``: cand, text."""
    return nodes.join(records, "cand", "left").select("cand", F.coalesce(F.nullif("text", F.lit("")), F.array_join(tokens("path"), " ")).alias("text"))


def tf_dot(queries: DataFrame, docs: DataFrame, idf: bool = False, min_df: int = 1) -> DataFrame:
    """(qid, cand, score): dot product of L2-normalised term counts, weighted by ln((1+N)/(1+df))+1 if ``idf``.

    Tokens of fewer than ``min_df`` documents count nowhere. Squared lengths are added up inside each row, and only query terms are
    shuffled. What rare tokens add to the lengths is taken off: those of a single document show by its id being smallest
    and largest, which partial counts of the vocabulary tell; a ``min_df`` above 2 needs all postings.
    """
    held = query_postings(queries, docs, norms=True)
    tf = held.where("tok IS NOT NULL")
    df = tf.groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    n = held.where("tok IS NULL").agg(F.count("*").alias("n"))
    weight = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1 if idf else F.lit(1.0)
    q = terms(queries).join(df, "tok").join(F.broadcast(n)).select("qid", "tok", "qtf", weight.alias("w"))
    q = materialise(q, "terms")
    qn = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qnorm"))
    q = q.join(qn, "qid").select("qid", "tok", (F.col("w") * F.col("qtf") / F.col("qnorm")).alias("w"))
    dots = dealt(held, queries).join(bounded(q, BROADCAST_WEIGHTS), "tok").groupBy("qid", "cand").agg(F.sum(F.col("w") * F.col("tf")).alias("dot"), F.max("square").alias("square"))
    if min_df > 1:
        dots = dots.join(rare_squares(docs, min_df), "cand", "left").withColumn("square", F.col("square") - F.coalesce("rare", F.lit(0)))
    return dots.select("qid", "cand", (F.col("dot") / F.sqrt("square")).alias("score"))


def rare_squares(docs: DataFrame, min_df: int) -> DataFrame:
    """(cand, rare): the sum of squared counts of each document's tokens that fewer than ``min_df`` documents have."""
    if min_df > 2:
        d = postings(docs, "cand", tokens("text"))
        rare = d.groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") < min_df).select("tok")
        return d.join(rare, "tok", "left_semi").groupBy("cand").agg(F.sum(F.col("tf") * F.col("tf")).alias("rare"))
    by = docs.select("cand", F.explode(tokens("text")).alias("tok")).groupBy("tok").agg(F.min("cand").alias("cand"), F.max("cand").alias("other"), F.count("*").alias("tf"))
    return by.where("cand = other").groupBy("cand").agg(F.sum(F.col("tf") * F.col("tf")).alias("rare"))


def hashed_log_tf(docs: DataFrame, id_col: str, toks: Column, dim: int = 16384) -> DataFrame:
    """(id, bucket, w): 1 + ln(count) of each token added up in its crc32 bucket."""
    tf = postings(docs, id_col, toks)
    return tf.groupBy("cand", F.pmod(F.crc32(F.col("tok").cast("binary")), F.lit(dim)).alias("bucket")).agg(F.sum(1 + F.log("tf")).alias("w"))


def overlap(queries: DataFrame, docs: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """(qid, cand, score): the number of distinct tokens in common, where there are any."""
    held = query_postings(queries, docs) if postings is None else postings
    return dealt(held, queries).join(bounded(terms(queries).select("qid", "tok")), "tok").groupBy("qid", "cand").agg(F.count("*").alias("score"))


def hashed_cosine(queries: DataFrame, docs: DataFrame, toks, dim: int = 16384) -> DataFrame:
    """(qid, cand, score): cosine of hashed log counts of ``queries`` (qid, text) and ``docs`` (cand, text).

    Texts are dealt by document in bounded partitions before they are split; counts, buckets, norms and products need no other shuffle.
    """
    q = hashed_log_tf(queries.withColumnRenamed("qid", "cand"), "cand", toks("text"), dim).withColumnRenamed("cand", "qid").withColumnRenamed("w", "qw")
    pairs = docs.count() * queries.count()
    v = hashed_log_tf(docs.repartition(max(parts(docs), -(-pairs // TASK_PAIRS)), "cand"), "cand", toks("text"), dim)
    v = v.groupBy("cand").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n_w"), F.collect_list(F.struct("bucket", "w")).alias("x"))  # the buckets of one document
    v = v.select("cand", "n_w", F.explode("x").alias("x")).select("cand", "n_w", "x.bucket", "x.w")
    norm = lambda df, key, w: df.groupBy(key).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias(f"n_{w}"))
    q = materialise(q, "buckets")
    q = bounded(q.join(norm(q, "qid", "qw"), "qid").select("qid", "bucket", (F.col("qw") / F.col("n_qw")).alias("qw")), BROADCAST_WEIGHTS)
    return v.join(q, "bucket").groupBy("qid", "cand").agg((F.sum(F.col("w") * F.col("qw")) / F.any_value("n_w")).alias("score"))


def path_proximity(changed: DataFrame, pool: DataFrame) -> DataFrame:
    """(qid, cand, n, j): the largest (tokens in common, Jaccard similarity) over the query's changed paths, in that order.

    ``changed``: qid, tokens of a changed path; ``pool``: qid, cand, tokens of the candidate's path.
    """
    both = pool.join(changed.select("qid", F.col("tokens").alias("own")), "qid")
    n = F.size(F.array_intersect("tokens", "own"))
    best = F.max(F.struct(n.alias("n"), F.coalesce(F.try_divide(n, F.size(F.array_union("tokens", "own"))), F.lit(0.0)).alias("j")))
    return both.groupBy("qid", "cand").agg(best.alias("x")).select("qid", "cand", F.col("x.n").cast("long").alias("n"), "x.j")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def similarity_profile(pairs: DataFrame, value: str = "j") -> DataFrame:
    """(n, median, share_above_0): the upper median is the value at n // 2 in order, found from counts of equal values."""
    counts = pairs.groupBy(F.round(value, 12).alias("v")).agg(F.count("*").alias("n"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("n").over(w))  # a row for each distinct similarity, a ratio of two set sizes
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)).alias("above"))
    return run.join(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("total", "above").agg(F.min("v").alias("median")).select(F.col("total").alias("n"), "median", (F.col("above") / F.col("total")).alias("share_above_0"))
