import random
import string

import pytest

from loomgraph.llm.secret_scan import candidates, find_secrets, redact_secrets
from loomgraph.llm.simhash import drop_near_copies, links, simhash_groups
from loomgraph.llm.spelling import spelling_variants


def test_secrets_after_an_equals_sign(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40)) for _ in range(60)]
    forms = ["KEY={}", "https://a.b/c?sig={}&x=1", "AWS_SECRET_ACCESS_KEY={}", "client_secret_key={}", "x = 1;KEY={}=="]
    texts = [forms[i % len(forms)].format(k) for i, k in enumerate(keys)]
    for t, k in zip(texts, keys):
        assert [t[s:e].rstrip("=") for s, e, *_ in candidates(t, [])] == [k]
    # A long name before the sign is no token of its own.
    assert candidates("a_name_of_over_twenty_characters=short", []) == []
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_random"] for r in find_secrets(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in redact_secrets(df).collect()}
    assert sum(found.values()) >= 48
    assert all(keys[i] not in clean[i] for i in found if found[i])


@pytest.fixture
def small_broadcasts(spark):
    """No table of over 16 MB can be broadcast."""
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "16m")
    yield
    spark.conf.unset(name)


def _singles_and_copies(spark):
    """8000 different texts, of which each hundredth comes twice: 528,000 signatures of a small table."""
    rows = [(i, f"a{i} b{i}") for i in range(8000)] + [(8000 + i, f"a{100 * i} b{100 * i}") for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_without_large_broadcasts(spark, small_broadcasts):
    kept = [r["doc_id"] for r in drop_near_copies(_singles_and_copies(spark)).collect()]
    assert sorted(kept) == list(range(8000))


def test_simhash_groups_without_large_broadcasts(spark, small_broadcasts):
    docs = _singles_and_copies(spark)
    groups = {r["doc_id"]: r["component_id"] for r in simhash_groups(docs).collect()}
    assert groups == {i: i if i < 8000 else 100 * (i - 8000) for i in range(8080)}
    # Neither pairs nor stars: signatures meet in shuffles whatever their tables' sizes.
    edges = links(spark.createDataFrame([(i,) for i in range(100)], "fp long"))
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tiny_broadcasts(spark):
    """No table of over 1.2 MB can be broadcast: a few thousand rows, however few bytes they are as Parquet."""
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "1200k")
    yield
    spark.conf.unset(name)


def test_simhash_groups_without_a_row_per_document_on_the_driver(spark, tiny_broadcasts):
    docs = spark.range(80000).selectExpr("id AS doc_id", "concat('a', id % 40000, ' b', id % 40000) AS text")
    got = simhash_groups(docs).selectExpr("count(*)", "count(DISTINCT fingerprint)", "count_if(component_id = doc_id % 40000)").first()
    assert tuple(got) == (80000, 40000, 80000)


def test_a_fingerprint_of_a_third_of_all_rows_stays_spread(spark):
    """No task of op8's result, nor of its survivors, gets a tenth of the rows, however many are equal."""
    docs = spark.range(12000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'one same text of many', concat('a', id, ' b', id, ' c', id)) AS text").repartition(16)
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        got = simhash_groups(docs).selectExpr("component_id", "spark_partition_id() AS p").groupBy("p").count().collect()
        repeated = docs.union(spark.range(4000).selectExpr("0L AS doc_id", "'one same text of many' AS text"))
        kept = drop_near_copies(repeated)
        assert kept.count() == 8001 and kept.select("doc_id").distinct().count() == 8001
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    assert sum(r["count"] for r in got) == 12000 and max(r["count"] for r in got) < 1200


def test_what_an_operator_holds_goes_with_the_next():
    """A worker that runs another operator gives up the caches of the one before."""
    from loomgraph.llm import common

    made = []
    one = lambda: common.held(("one",), lambda: made.append(1) or {"cache": 1})
    common.own_kernel(one)
    common.own_kernel(one)
    assert made == [1] and ("one",) in common._held
    common.own_kernel(lambda: None)
    assert not common._held


def test_spelling_variants_without_a_row_per_word_on_the_driver(spark, tiny_broadcasts):
    """20,000 words in pairs, one a form of the other: neither words nor what is left of them, forms or roots are broadcast."""
    words = spark.range(20000).selectExpr("id div 2 AS p", "id % 2 AS m", "translate(lpad(CAST(id div 2 AS STRING), 6, '0'), '0123456789', 'abcdefghij') AS w")
    # Tripled letters keep different pairs apart by more than one code point.
    pairs = words.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat(concat(regexp_replace(w, '(.)', '$1$1$1'), IF(m = 0, '', 'z'), ' '), IF(m = 0, 6, 3)) AS text")
    got = spelling_variants(pairs)
    assert got.count() == 20000 and got.where("n = 3 AND form = root AND form_n = 6 AND n_near = 1 AND word = concat(form, 'z')").count() == 10000
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
