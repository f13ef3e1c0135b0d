"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the corpus (op8).

DataFrame functions only.  One pass counts hashed one- and two-word grams of all documents, and
of the trusted ones among them, into a fixed number of buckets; the two smoothed multinomials
give a weight for each bucket; a document's score is the mean weight of its grams and it is
kept from a fixed threshold on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams

#: Buckets, most trusted documents (those with the smallest hashes of their ids), smoothing, least mean log-ratio
#: (where labelled texts separate, also those held out of the fit; README).
BUCKETS, TRUSTED, SMOOTHING, THRESHOLD = 8192, 20_000, 1.0, -0.05
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, REPEAT_WINDOW = 20, 30, 8


def repeat_words(wh: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words in windows that occur twice or more in the text."""
    def marked(hs):
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s):
            twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            at = F.array_sort(F.transform(twice, lambda x: x["i"]))
            zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum"))
            return F.aggregate(at, zero, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(window), p - a["last"])).alias("sum")), lambda a: a["sum"])

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(grams.let(pairs, places))

    each = F.transform(F.slice(wh, F.lit(1), F.greatest(F.size(wh) - (window - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(wh, i + k) for k in range(1, window)]))
    return F.when(F.size(wh) <= window, F.lit(0)).otherwise(grams.let(each, marked))


def base_columns(text: Column, ws: Column, wh: Column) -> list[Column]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_words."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        (F.length(plain) - F.length(F.regexp_replace(plain, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        grams.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(wh).cast("long").alias("n_repeat_words"),
    ]


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids labelled only with quality 1 and toxic 0, at most ``most`` of them, by hash."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    return good.select(F.col("doc_id").alias("trusted_id")).orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def gram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with ``weights``: log of trusted over raw probability for each bucket."""
    rows = docs.select(F.col(id_col).alias("trusted_id"), F.col(text_col).alias("text")).join(F.broadcast(trusted.withColumn("is_trusted", F.lit(1))), "trusted_id", "left")
    both = grams.let(grams.hashes(grams.words(F.col("text"))), lambda h: F.concat(grams.unigrams(h, buckets), grams.bigrams(h, buckets)))
    counts = grams.exploded(rows, both, "bucket", "is_trusted").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("is_trusted").alias("good"))
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("all_good"))
    a = F.lit(float(smoothing))
    each = counts.withColumn("one", F.lit(0)).join(F.broadcast(sums.withColumn("one", F.lit(0))), "one")
    # no trusted text: no preference
    weight = F.when(F.col("all_good") == 0, F.lit(0.0)).otherwise(F.log((F.col("good") + a) / (F.col("all_good") + a * buckets)) - F.log((F.col("raw") + a) / (F.col("all_raw") + a * buckets)))
    return grams.as_row(each.select("bucket", weight.alias("weights")), "bucket", ["weights"], buckets, {"weights": F.lit(0.0)})


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column ``rules``: the base columns, llr, base_failed and kept.

    A null or empty text has no words and fails the base rule, with llr 0.  Every row is judged
    by itself, so repeated rows and null ids get the verdict of their text.  Without labels, or
    without trusted documents, llr is 0 for all and only the base rule rejects.  Columns of docs
    are kept whatever their names ("rules" is replaced).
    """
    names = [c for c in docs.columns if c != "rules"]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    text = F.col("_doc")[text_col]
    row = gram_weights(docs, trusted_ids(labels), id_col, text_col, buckets)
    weighted = grams.with_row(inner, row)

    def rules(ws):
        def more(wh):
            both = F.concat(grams.unigrams(wh, buckets), grams.bigrams(wh, buckets))
            llr = grams.let(both, lambda g: F.when(F.size(g) > 0, grams.total(g, F.col("weights")) / F.size(g)).otherwise(F.lit(0.0)))
            return F.struct(*base_columns(text, ws, wh), llr.alias("llr"))

        return grams.let(grams.hashes(ws), more)

    judged = grams.once(weighted, "_doc", grams.let(grams.words(text), rules).alias("r"))
    failed = (F.col("r.n_words") < LEAST_WORDS) | (100 * F.col("r.n_repeat_words") > MOST_REPEATED_PERCENT * F.col("r.n_words"))
    kept = ~failed & (F.col("r.llr") >= F.lit(threshold))
    return judged.select("_doc.*", F.struct("r.*", failed.alias("base_failed"), kept.alias("kept")).alias("rules"))
