"""Spelling variants of a corpus's words, without any pair of words ever being made.

A word is near another if they differ by one inserted, deleted or replaced code point. Replacements: a word is in one group for each of
its places, named by what stands before and behind that place. Words of one group are near each other, and each two near words share
exactly one group; of a group only its size and its two most frequent words are told to its members. Insertions and deletions: a word
with one code point deleted is looked up in the vocabulary; what is found is near, in both directions.

A group holds one word for each letter of the alphabet at most (LETTERS: 116 code points), and a word is reached by deletion from at most
(length + 1) times as many words, however often the words occur. So no group grows with the corpus but the counts of
words, which are added up before they are moved.

Nulls and empty texts have no words; a null doc_id counts as an empty string where ids are hashed. Rows that repeat count as often as they
stand there. Words with the same count go by code points. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Code points of words.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: One of so many (document, run) pairs loses a code point; 0: none.
NOISE = 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for any code point in the name of a group; no letter.
WILDCARD = "*"


def _without(word: str, place: str, instead: str = "") -> str:
    """SQL for a word whose code point at a place (from 1) is replaced or left out."""
    middle = f", '{instead}'" if instead else ""
    return f"concat(substring({word}, 1, {place} - 1){middle}, substring({word}, {place} + 1))"


def lowered(run: str) -> Column:
    """A-Z in lower case, nothing else."""
    ascii_only = f"octet_length({run}) = length({run})"
    return F.expr(f"CASE WHEN {ascii_only} THEN lower({run}) ELSE translate({run}, '{_UPPER}', '{_LOWER}') END")


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): words of at least so many code points that occur so often in all texts of (doc_id, text)."""
    # a shorter run gives no word; a run that is long enough is matched from its first to its last letter
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    rows = rows.select("id", lowered("run").alias("word"))
    if noise:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        lost = _without("word", "(cast(h % length(word) AS int) + 1)")
        rows = rows.select(F.expr(f"CASE WHEN h % {noise} = 0 THEN {lost} ELSE word END").alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _replaced(words: DataFrame) -> DataFrame:
    """(word, near, best): how many words of its wildcard groups are near a word, and the most frequent of them; a row a group."""
    names = F.expr(f"explode(transform(sequence(1, length(word)), i -> {_without('word', 'i', WILDCARD)}))")
    grouped = words.select("word", "n", names.alias("name"))
    group = Window.partitionBy("name")
    ordered = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))
    told = grouped.select(
        "word", F.count("*").over(group).alias("size"), F.first(member).over(ordered).alias("top"), F.nth_value(member, 2).over(ordered).alias("second")
    ).where("size > 1")
    other = F.when(F.col("top.form") == F.col("word"), F.col("second")).otherwise(F.col("top"))
    return told.select("word", (F.col("size") - 1).alias("near"), other.alias("best"))


def _shortened(words: DataFrame, least_chars: int) -> DataFrame:
    """(word, near, best) of words that become one another by a deletion; each such meeting is told to both."""
    shorter = F.expr(f"explode(array_distinct(transform(sequence(1, length(word)), i -> {_without('word', 'i')})))")
    cut = words.where(F.length("word") > least_chars).select("word", "n", shorter.alias("short"))
    met = cut.join(words.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short")
    tell = lambda to, n, form: F.struct(F.col(to).alias("word"), F.struct((-F.col(n)).alias("less"), F.col(form).alias("form")).alias("best"))
    both = met.select(F.explode(F.array(tell("word", "short_n", "short"), tell("short", "n", "word"))).alias("x"))
    return both.select("x.word", F.lit(1).cast("long").alias("near"), "x.best")


def near_forms(words: DataFrame, least_chars: int = LEAST_CHARS, ratio: float = RATIO) -> DataFrame:
    """words (word, n) with n_near, form and form_n. least_chars: no word is shorter."""
    facts = _replaced(words).unionByName(_shortened(words, least_chars))
    told = facts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    rows = words.join(told, "word", "left")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    return rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last one, which is at most so many steps away. Each round doubles the steps taken."""
    spark, now = forms.sparkSession, written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, now = now, written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        forget(spark, before)
    return now


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: float = RATIO, noise: int = NOISE) -> DataFrame:
    """One row a word of the vocabulary: word, form, root, n, n_near, form_n.

    form: its most frequent near word (ties: the smallest), if that is `ratio` (more than 1) times as frequent; else null. root: the last
    of the forms that follow one another, or the word itself.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1: forms could lead back to a word")
    words = written(vocabulary(docs, least_chars, least_count, noise), "words")
    most = words.agg(F.max("n")).first()[0] or 1
    found = written(near_forms(words, least_chars, ratio), "forms")
    # each step multiplies the count by the ratio at least
    steps = int(math.log(max(most / max(least_count, 1), 1), ratio)) + 1
    last = roots(found.where("form IS NOT NULL"), steps)
    rows = found.join(last, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
