"""Grouping of spelling variants by a symmetric-delete join.

Words are counted over whole texts. Each word then emits itself and its distinct single deletions, as 64-bit hashes; two words at an
edit distance of one share one of these, so an equi-join on the hash finds every pair, and exact distances drop what else it finds,
hashes that collide included. Per word the near words are counted and the most frequent one taken as its form if it is frequent enough.
Forms are more frequent than their words by the ratio, so they make trees, and pointer jumping finds the roots in as many joins as
the logarithm of the longest chain, which itself is at most a logarithm of the greatest count.

Words are distinct, so no key of the join is hot: at most one word a letter and place shares a deletion. What hot words, sources or
texts cost is counting, and that is added up before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_in(docs: DataFrame, min_chars: int = 6, letters: str = r"A-Za-z\u00C0-\u00FF", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word) for each maximal run of letters of at least min_chars, with A-Z lower-cased. Null and empty texts have none; ids may be null or
    repeat, and repeated rows count each."""
    runs = F.regexp_extract_all(F.translate(text_or_empty(F.col(text_col).cast("string")), UPPER, LOWER), F.lit(f"[{letters}]{{{min_chars},}}"), 0)
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("word"))


def count_words(words: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of words(word), those of at least min_chars and min_count occurrences; null words don't count."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keys(word: str) -> Column:
    """Hashes of the word and its distinct single deletions."""
    return F.expr(f"array_distinct(transform(sequence(0, length({word})), i -> if(i = 0, xxhash64({word}), xxhash64(concat(substring({word}, 1, i - 1), substring({word}, i + 1))))))")


def near_pairs(counts: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways round, for all pairs of counts(word, n) at an edit distance of one in code points."""
    keyed = counts.select("word", "n", F.explode(_keys("word")).alias("key"))
    other = keyed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    close = F.levenshtein("word", "near", 1) == 1
    return keyed.join(other, "key").where((F.col("word") != F.col("near")) & close).select("word", "near", "near_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): what following forms leads to. Each round doubles how far a word has looked."""
    reached, _ = scratch(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        reached, _ = scratch(reached.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = reached.where("moved").limit(1).count()
        reached = reached.drop("moved")
        if not moved:
            return reached


def group_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """counts(word, n), words distinct, with form, root, n_near and form_n.

    n_near counts the words at distance one. A word's form is the most frequent of these, the first in code-point order of equals, if it is at
    least `ratio` (2 or more) times as frequent, else null; form_n is the form's n. root is where following forms ends, the word itself
    without any. An empty table gives an empty result; null words are left out.
    """
    if ratio < 2:
        raise ValueError("forms make trees only if each is more frequent than its word")
    counts, _ = scratch(counts.where(F.col("word").isNotNull()).select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(counts).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = counts.join(near, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed, _ = scratch(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).cast("long").alias("form_n"))
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_slips(words: DataFrame, every: int = 199) -> DataFrame:
    """words(id, word) with a slip of the pen in one of `every` pairs of id and word: their crc32 h picks the pairs that it divides, and the code
    point h % length that goes. A null id is spelled empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = F.expr("cast(h % length(word) as int)")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return words.withColumn("h", h).select("id", F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_variants over the words of all documents, with the slips that the query's contract plants; nulls, repeats, empty tables and
    extra columns as there."""
    return group_variants(count_words(with_slips(words_in(table(spark, sf_dir, "documents")))))
