"""Spelling variants by wildcard groups: neighbours are counted, and the best one found, without making pairs."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


@dataclass(frozen=True)
class Settings:
    """``letters``: the inside of a character class, no ``*`` in it; a run of them is a word. ``thin``: a run is thinned where this divides its hash."""

    letters: str = r"A-Za-zÀ-ÿ"
    thin: int = 97
    min_length: int = 5
    min_count: int = 3
    #: A form is at least so many times as frequent.
    ratio: int = 2


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_counts(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of all texts, some thinned by a code point, that are long and frequent enough.

    A run's hash is the crc32 of ``<id>:<run>``, so all its places in a document are thinned alike. Null
    ids thin nothing.
    """
    s = settings
    runs = df.select(F.col(id_col).alias("sv_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{s.letters}]+"), F.lit(0))).alias("sv_run"))
    runs = runs.where(F.char_length("sv_run") >= s.min_length).select("sv_id", ascii_lower(F.col("sv_run")).alias("sv_run"))
    hashed = runs.withColumn("sv_h", F.crc32(F.concat(F.col("sv_id").cast("string"), F.lit(":"), "sv_run").cast("binary")))
    at = F.expr("CAST(sv_h % char_length(sv_run) AS INT)")
    thinned = F.concat(F.substring("sv_run", F.lit(1), at), F.substring("sv_run", at + 2, F.char_length("sv_run")))
    word = F.when(F.col("sv_h") % s.thin == 0, thinned).otherwise(F.col("sv_run"))
    words = hashed.select(word.alias("word")).where(F.char_length("word") >= s.min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.min_count)


#: Sorts the most frequent word first, then the one of least code points.
_RANK = "struct(-n AS lead, word)"
#: Of each position that can be left out, the word without it; neighbours of a run of equal letters give one.
_DELETIONS = "array_distinct(transform(sequence(1, char_length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1))))"
_WILDCARDS = "transform(sequence(1, char_length(word)), i -> concat(substring(word, 1, i - 1), '*', substring(word, i + 1)))"


def _replacements(vocab: DataFrame) -> DataFrame:
    """(word, near, best) for each wildcard group of two words or more that the word is in.

    A group is a position with the prefix and the suffix around it, written ``pre*fix``. Its words
    differ in one letter, so it never holds more of them than there are letters.
    """
    groups = vocab.select(F.explode(F.expr(_WILDCARDS)).alias("hole"), F.expr(_RANK).alias("own")).groupBy("hole").agg(
        F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("own")).alias("own")
    )
    top = groups.where("size > 1").select("size", F.expr("slice(own, 1, 2)").alias("top"), F.explode("own").alias("own"))
    return top.select(F.col("own.word").alias("word"), F.expr("size - 1").alias("near"), F.expr("IF(own = top[0], top[1], top[0])").alias("best"))


def _indels(vocab: DataFrame, shortest: int) -> DataFrame:
    """(word, near, best) of words that are another one with a letter left out, for both of the two, aggregated on either side."""
    longer = vocab.where(F.char_length("word") > shortest).select("word", "n", F.explode(F.expr(_DELETIONS)).alias("gone"))
    short = vocab.select(F.col("word").alias("gone"), F.col("n").alias("gone_n"))
    met = longer.join(short.hint("merge"), "gone")
    up = met.groupBy("gone").agg(F.count(F.lit(1)).alias("near"), F.min(F.expr(_RANK)).alias("best")).withColumnRenamed("gone", "word")
    down = met.groupBy("word").agg(F.count(F.lit(1)).alias("near"), F.min(F.expr("struct(-gone_n AS lead, gone AS word)")).alias("best"))
    return up.unionByName(down)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling: a form is more frequent than its word, so there are no rings, and few rounds."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(
            now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        done = after.where("moved").isEmpty()
        release(now)
        now = after.select("word", "root")
        now._loomgraph_path = after._loomgraph_path
        if done:
            return now


def spelling_variants(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: its frequent neighbour ``form`` (null if none), ``root`` (the last of the forms from it), n, n_near, form_n.

    Two words are near if one code point is inserted, deleted or replaced. Words that differ by a
    replacement share one wildcard group, which gives each of its words the others' number and the
    best of the top two that is not itself. For insertions and deletions, what is left of each word
    without one code point is joined with the vocabulary itself. All of it is counts and minima by
    key: a word of length k makes 2k rows, whatever its neighbours. Joins are told to shuffle: the planner
    would broadcast a row for each word or deletion by the few bytes that they are as Parquet.

    Null or empty texts have no words. Very long texts count whole. Null ids: runs are not thinned.
    Repeated rows count again. Ties of n: the word of least code points. Empty table: no rows. Other
    input columns are not read.
    """
    s = settings
    vocab = materialize(word_counts(df, s, id_col, text_col), "spelling-vocabulary")
    found = _replacements(vocab).unionByName(_indels(vocab, s.min_length))
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    own = vocab.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.lead")).alias("form_n"))
    fits = F.col("form_n") >= s.ratio * F.col("n")
    own = own.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))})
    own = materialize(own, "spelling-forms")
    roots = _roots(own.where("form IS NOT NULL"))
    return own.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
