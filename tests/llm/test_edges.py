"""Letters, ids that are null, texts that are null or empty, and columns that are named as helpers are."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, langid, secrets, simhash

NAMES = ["_d", "_k", "_spans", "_id", "_key", "_p", "_D_", "_p_", "text_key", "hash", "n", "set", "key", "owner"]
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def crowded(spark, rows):
    """doc_id, text, lang, source and a column of every helper name."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


@pytest.mark.parametrize(("text", "letter"), [("½ ²", False), ("①", False), ("Ⅷ", False), ("_1", False), ("٣", False), ("ª", True), ("文", True), ("1a", True), ("é", True)])
def test_letters_are_unicode_letters(spark, text, letter):
    rows = [(i, "the and of", "en", "s") for i in range(30)] + [(i, "der die und", "de", "s") for i in range(30, 60)] + [(99, text, "en", "s")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[99] != "und") == letter


def test_items_without_an_id_contaminate(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "one two"), (3, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "a b"), (7, "b c")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_contamination(docs, items).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (3, 1, sha(""), True), 2: (0, 0, sha(""), False), 3: (3, 2, sha("7"), True)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]


def test_null_and_empty_texts_are_one(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (1, ""), (2, ""), (3, "a b")], "doc_id long, text string")
    before = spark.conf.get(ARROW)
    got = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3] and got.columns == docs.columns
    assert spark.conf.get(ARROW) == before


def test_helper_names_come_through(spark):
    secret = "password = hunter2hunter2"
    rows = [(i, f"the word of a text number {i} and more", "en", "s") for i in range(8)] + [(20, secret, "en", "s"), (21, "der die das und", "de", "s"), (22, None, None, None), (22, "", None, None)]
    docs = crowded(spark, rows)
    items = spark.createDataFrame([(1, "text number 3")], "item_id long, text string")
    for kept in (langid.keep_identified(docs), secrets.mask_live(docs), decontaminate.drop_contaminated(docs, items), simhash.keep_first(docs)):
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert [r[n] for n in NAMES] == list(range(len(NAMES)))
    masked = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert masked[20] == "password = [SECRET]"
    assert 3 not in {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()}
