"""Lexical retrieval over entities, and exact vector search."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens, fold, folded, safe_pattern, token_column
from ..plans.budget import BudgetExceeded, VectorBinding
from ..runtime import materialize

# Weights of fields in a text search: of their tokens, of a name equal to the query, of one that begins so.
TOKEN_BOOST = {"name": 10.0, "qualified_name": 8.0, "path": 6.0, "signature": 3.0, "type_names": 3.0, "documentation": 1.0}
EXACT_BOOST = {"n": 24.0, "q": 20.0, "p": 18.0}
PREFIX_BOOST = {"n": 16.0, "q": 12.0, "p": 10.0}
K1, B = 1.2, 0.75


def lexical_documents(entities: DataFrame) -> DataFrame:
    """Entities with folded names and the flags that ranking uses; the optional text fields are kept."""
    parent = entities.select(F.col("id").alias("container_id"), F.col("kind").alias("container_kind"))
    abstract = ("interface", "trait", "protocol")
    rows = entities.join(parent, "container_id", "left")
    declaration = F.col("path").rlike(r"\.d\.[mc]?ts$") | F.col("kind").isin(*abstract, "type_alias") | F.coalesce(F.col("container_kind").isin(*abstract), F.lit(False))
    return rows.select(
        "id", "name", "qualified_name", "path", "kind", "language", "tier", (F.col("kind") == "test").alias("test"), declaration.alias("declaration_only"),
        folded("name").alias("n"), folded("qualified_name").alias("q"), folded("path").alias("p"),
        *[c for c in ("signature", "type_names", "documentation") if c in entities.columns],
    )


def lexical_postings(documents: DataFrame) -> DataFrame:
    """(id, field, term, length, tf): the inverted index of ``lexical_documents``, to be stored beside it.

    An entity's id is its own, so a field's terms are counted where they stand: sorted, each run of equal
    ones is a term. Nothing is grouped over rows.
    """
    fields = [f for f in TOKEN_BOOST if f in documents.columns]
    each = documents.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), token_column(f).alias("w")) for f in fields])).alias("x")).select("id", "x.*")
    each = each.where(F.size("w") > 0).select("id", "field", F.size("w").alias("length"), F.array_sort("w").alias("w"))
    first = F.filter(F.sequence(F.lit(1), F.col("length")), lambda i: (i == 1) | (F.get("w", i - 1) != F.get("w", i - 2)))
    each = each.withColumn("first", first)
    each = each.select("id", "field", "length", "w", F.inline(F.arrays_zip(F.col("first").alias("at"), F.array_append(F.slice("first", F.lit(2), F.col("length")), F.col("length") + 1).alias("next"))).alias("at", "next"))
    return each.select("id", "field", F.get("w", F.col("at") - 1).alias("term"), "length", (F.col("next") - F.col("at")).cast("long").alias("tf"))


def token_scores(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(id, matched, score): how many of ``terms`` a document holds in any field, and its boosted BM25 over the fields."""
    docs = postings.groupBy("id", "field").agg(F.max("length").alias("length"))
    totals = docs.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))  # a row for each field
    found = postings.where(F.col("term").isin(*terms))
    df = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # a row for each field and term asked for
    rows = found.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(totals), "field")
    part = inverse_frequency(F.col("docs"), F.col("df")) * saturated(F.col("tf"), F.col("length"), F.col("mean"))
    return rows.groupBy("id").agg(F.count_distinct("term").cast("int").alias("matched"), F.sum(boost_of("field") * part).alias("score"))


def definition_rank() -> Column:
    """What comes first of one lexical class: definitions, then declarations, then tests."""
    return F.col("declaration_only").cast("int") + F.when(F.col("test"), 2).otherwise(0)


def saturated(tf: Column, length: Column, mean: Column) -> Column:
    """The part of BM25 that a document's own counts make; it grows with ``tf`` and falls with ``length``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def inverse_frequency(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def boost_of(field: str) -> Column:
    return F.create_map(*[F.lit(x) for p in TOKEN_BOOST.items() for x in p])[F.col(field)]


#: Blocks that a search scores before it knows what the others have to reach.
FIRST_BLOCKS = 64
_BLOCK = ("file", "class", "language")


@dataclass(frozen=True)
class LexicalIndex:
    """A stored inverted index: ``postings`` (file, class, language, id, field, term, tf, length), ``maxima`` (of each block, that is file, class and language: field, term, n, max_tf, min_length), ``lengths`` (file, field, docs, total).

    Postings and maxima lie in folders by the hash of their term, sorted by it, so a search reads the
    folders of its terms. All three are kept file by file in a snapshot store: a new generation writes
    those of changed files, and reads merge the rest.
    """

    postings: DataFrame
    maxima: DataFrame
    lengths: DataFrame
    buckets: int

    @staticmethod
    def tables(documents: DataFrame, buckets: int = 64) -> dict[str, DataFrame]:
        """The index of ``lexical_documents``, to be staged as parts that the files own, partitioned by ``LexicalIndex.PARTITIONS``."""
        part = F.pmod(F.xxhash64("file"), F.lit(LexicalIndex.PARTS))
        of = documents.select("id", F.col("path").alias("file"), definition_rank().alias("class"), "language")
        postings = lexical_postings(documents).join(of, "id").withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
        postings = materialize(postings.repartition("bucket", part).sortWithinPartitions("bucket", "term", "file"), "lexical-postings")
        maxima = postings.groupBy(*_BLOCK, "field", "term", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
        lengths = postings.groupBy("file", "id", "field").agg(F.max("length").alias("length")).groupBy("file", "field").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("total"))
        return {"postings": postings, "maxima": maxima.repartition("bucket", part).sortWithinPartitions("bucket", "term"), "lengths": lengths}

    PARTITIONS = {"postings": ["bucket"], "maxima": ["bucket"]}
    #: Parts by file of a folder of terms as it is written, so a term of most documents is not sorted by one task.
    PARTS = 16

    def _of(self, table: DataFrame, terms: list[str], languages: list[str] | None) -> DataFrame:
        """Rows of ``terms`` alone, read from their folders."""
        spark = table.sparkSession
        folders = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.hash("t"), F.lit(self.buckets))).collect()})
        rows = table.where(F.col("bucket").isin(folders) & F.col("term").isin(terms))
        return rows.where(F.col("language").isin(*languages)) if languages else rows

    def best(self, terms: list[str], named: DataFrame, need: int, languages: list[str] | None = None, max_postings: int = 1_000_000) -> DataFrame:
        """(id, matched, score) of at least all documents that hold all ``terms`` and are among the first ``need`` by class and score, and of those in the blocks ``named``.

        A block's maxima bound what a document in it can score. The first blocks by class and bound are
        scored; what their ``need``-th document has, all other blocks have to be able to reach. If more
        postings than ``max_postings`` would be read, the search is refused before it reads them.
        """
        known = materialize(self._of(self.maxima, terms, None), "lexical-maxima")
        df = known.groupBy("field", "term").agg(F.sum("n").alias("df"))  # a row for each field and term asked for
        means = self.lengths.groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("total") / F.sum("docs")).alias("mean"))  # a row for each field
        weights = df.join(F.broadcast(means), "field").select("field", "term", (boost_of("field") * inverse_frequency(F.col("docs"), F.col("df"))).alias("weight"), "mean")
        weights = materialize(weights, "lexical-weights")
        asked = known.where(F.col("language").isin(*languages)) if languages else known
        bounds = asked.join(F.broadcast(weights), ["field", "term"]).groupBy(*_BLOCK).agg(
            F.count_distinct("term").alias("held"), F.sum("n").alias("rows"), F.sum(F.col("weight") * saturated(F.col("max_tf"), F.col("min_length"), F.col("mean"))).alias("bound")
        )
        bounds = materialize(bounds.where(F.col("held") == len(terms)), "lexical-bounds")
        null_safe = lambda a, b: F.col(f"{a}.file").eqNullSafe(F.col(f"{b}.file")) & (F.col(f"{a}.class") == F.col(f"{b}.class")) & F.col(f"{a}.language").eqNullSafe(F.col(f"{b}.language"))

        def scored(blocks: DataFrame) -> DataFrame:
            rows = blocks.agg(F.sum("rows")).first()[0] or 0
            if rows > max_postings:
                raise BudgetExceeded("postings", max_postings)
            found = self._of(self.postings, terms, languages).alias("p").join(blocks.alias("b"), null_safe("p", "b")).select("p.*")
            found = found.join(F.broadcast(weights), ["field", "term"])
            part = F.col("weight") * saturated(F.col("tf"), F.col("length"), F.col("mean"))
            return found.groupBy("id", "class").agg(F.count_distinct("term").cast("int").alias("matched"), F.sum(part).alias("score"))

        lead = bounds.orderBy("class", F.desc("bound"), "file").limit(FIRST_BLOCKS)
        lead = materialize(lead, "lexical-first")
        first = materialize(scored(lead), "lexical-scored")
        last = first.where(F.col("matched") == len(terms)).orderBy("class", F.desc("score")).limit(need).collect()
        rest = bounds.alias("a").join(lead.alias("b"), null_safe("a", "b"), "left_anti")
        if len(last) == need:
            at = last[-1]
            reach = (F.col("class") < at["class"]) | ((F.col("class") == at["class"]) & (F.col("bound") >= at["score"] - 1e-6))
            rest = rest.alias("a").join(named.alias("b"), null_safe("a", "b"), "left_semi").unionByName(rest.where(reach)).distinct()
        rest = materialize(rest, "lexical-rest")
        return first.select("id", "matched", "score").union(scored(rest).select("id", "matched", "score"))


def _rank(mode: str, query: Column) -> Column:
    if mode == "exact":
        return F.when(F.col("n") == query, 0).when(F.col("q") == query, 1).otherwise(2)
    if mode in ("regex", "glob"):
        return F.lit(6)
    out = F.lit(6)
    tests = [F.col(c) == query for c in "nqp"] + [F.col(c).startswith(query) for c in "nqp"]
    for i in reversed(range(6)):
        out = F.when(tests[i], i).otherwise(out)
    return out


def locate(
    documents: DataFrame,
    mode: str,
    query: str,
    languages: list[str] | None = None,
    limit: int = 20,
    offset: int = 0,
    postings: DataFrame | None = None,
    index: LexicalIndex | None = None,
    max_postings: int = 1_000_000,
) -> DataFrame:
    """(position, id, name, lexical_rank, definition_rank, score): hits in final order.

    Order: lexical class, definition class, score downwards, id. Languages are filtered before
    ranking, so the page is full. Modes: exact, prefix, text, path, regex, glob. Text finds names
    equal to the query, names that begin so, and documents that hold all of its tokens; its score
    adds the boosts of the first two to the boosted BM25 of the third, over ``postings`` (by default
    those of ``documents``) or a stored ``index`` of them, of which it reads what can reach the page, and
    no more than ``max_postings``. The other modes score 0.
    """
    q = folded(F.lit(query))
    rows = documents.where(F.col("language").isin(*languages)) if languages else documents
    score = F.lit(0.0)
    if mode == "exact":
        hit = (F.col("n") == q) | (F.col("q") == q) | (F.col("p") == q)
    elif mode == "path":
        hit = F.col("p").startswith(q)
    elif mode in ("regex", "glob"):
        pattern = safe_pattern(fold(query), mode == "glob")
        hit = F.col("n").rlike(pattern) | F.col("q").rlike(pattern) | F.col("p").rlike(pattern)
    else:
        if len(query) < 2:
            raise ValueError("a prefix has two characters or more")
        hit = F.col("n").startswith(q) | F.col("q").startswith(q) | F.col("p").startswith(q)
        terms = sorted(set(code_tokens(query)))
        if mode == "text" and terms:
            if index:
                named = rows.where(hit).select(F.col("path").alias("file"), definition_rank().alias("class"), "language").distinct()
                full = index.best(terms, named, offset + limit, languages, max_postings)
            else:
                full = token_scores(postings if postings is not None else lexical_postings(documents), terms)
            full = full.where(F.col("matched") == len(terms))
            rows = rows.join(full.select("id", F.col("score").alias("tokens")), "id", "left")
            hit = hit | F.col("tokens").isNotNull()
            score = F.coalesce("tokens", F.lit(0.0))
            for boosts, test in ((EXACT_BOOST, lambda c: F.col(c) == q), (PREFIX_BOOST, lambda c: F.col(c).startswith(q))):
                for c, boost in boosts.items():
                    score = score + F.when(test(c), boost).otherwise(0.0)
    found = rows.where(hit).select(
        "id", "name", _rank("prefix" if mode == "path" else mode, q).alias("lexical_rank"),
        definition_rank().alias("definition_rank"), F.round(score, 6).alias("score"),
    )
    order = [F.col("lexical_rank"), F.col("definition_rank"), F.desc("score"), F.col("id")]
    page = found.orderBy(*order).limit(offset + limit)  # top-k per task first; only the page is numbered
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("position") > offset).select("position", "id", "name", "lexical_rank", "definition_rank", "score")


def bm25(documents: DataFrame, id_col: str, text: Column, terms: list[str], limit: int = 10) -> DataFrame:
    """(id, score) of the best documents; frequencies over the whole table, only the terms' postings shuffled."""
    words = documents.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)")).alias("w"))
    totals = words.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("w")).alias("mean"))  # one row
    wanted = F.array(*[F.lit(t) for t in terms])
    each = words.select("id", F.size("w").alias("length"), F.explode(F.filter("w", lambda x: F.array_contains(wanted, x))).alias("term"))
    tf = each.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term asked for
    rows = tf.join(F.broadcast(df), "term").join(F.broadcast(totals))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, clamped to -1..1."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total(a, b) / F.sqrt(total(a, a) * total(b, b))))


def nearest(
    vectors: DataFrame,
    query: list[float],
    limit: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    binding: tuple[VectorBinding, VectorBinding] | None = None,
) -> DataFrame:
    """(id, score): exact top-k by cosine, ties by id; rows of another length, zero or non-finite are rejected.

    ``binding``: what the table was made from and what the query was; they have to be the same.
    """
    if binding:
        binding[0].check(binding[1])
    if not query or not all(map(math.isfinite, query)) or not any(query):
        raise ValueError("a finite vector that is not zero is needed")
    q = F.array(*[F.lit(float(x)) for x in query])
    fit = (F.size(vector_col) == len(query)) & F.exists(vector_col, lambda x: x != 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fit).select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)
