"""Re-parameterised questions: names that open sentences, number words, units, and what stays clean."""

import pytest

from clickfeat.llm import decontam

ITEM = ("Tom has 3 apples in a basket. Tom buys 4 more pears at the market for 2 dollars. Anna takes 1 apple from the basket. "
        "How many pieces of fruit does Tom have left at home?")
OTHERS = ("The old harbour lies quiet in the morning fog while fishermen mend their nets and gulls cry above the roofs of the town.")


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r["doc_id"] for r in decontam.leaks(docs, asked).collect() if r["leaked"]}


@pytest.mark.parametrize("change", [
    lambda t: t.replace("Tom", "Mary"), lambda t: t.replace("Tom", "Mary").replace("Anna", "Ben"),
    lambda t: t.replace("Tom", "Mary").replace("3", "13").replace("4", "7"), lambda t: t.replace("3", "three").replace("4", "four"),
    lambda t: t.replace("Tom", "Élodie").replace("3", "Seven"), lambda t: t.replace("dollars", "euros"),
    lambda t: "Quiz time.\n" + t.replace("Tom", "Mary"), lambda t: "and then " + t.replace("Tom", "Kim"),
    lambda t: OTHERS + " " + t.replace("Tom", "Mary") + " " + OTHERS, lambda t: t])
def test_variants_leak(spark, change):
    assert found(spark, [OTHERS, change(ITEM), OTHERS[::-1]]) == {1}


def test_mixed_up_names_do_not(spark):
    """Two names of the item become one, or one becomes two: another question."""
    assert found(spark, [ITEM.replace("Anna", "Tom"), ITEM.replace("Tom has", "Mary has")]) == set()


def test_item_and_document_may_differ_in_the_first_words_case(spark):
    item = "Purple zebra herds cross the shallow river long before the early summer rain begins to fall"
    assert found(spark, ["we saw that purple" + item[6:], item, "Purple" + item[6:]], [item]) == {0, 1, 2}
    low = item[0].lower() + item[1:]
    assert found(spark, ["It is so.\n" + item, "so " + low], [low]) == {0, 1}


def test_openers_are_words_and_other_capitals_are_names(spark):
    text = "The dog ran. Rover barked. Twenty cats and 3 km later She met McDonald in Paris"
    row = spark.createDataFrame([(text,)], "text string").select(
        decontam.template_words(decontam.F.col("text")).alias("t"), decontam.raw_words(decontam.F.col("text")).alias("raw")).first()
    n, m, u = decontam.NUM, decontam.NAME, decontam.UNIT
    assert row["t"] == ["the", "dog", "ran", m, "barked", n, "cats", "and", n, u, "later", "she", "met", "mcdonald", "in", m]
    assert len(row["raw"]) == len(row["t"])


def test_tables_are_small():
    assert len(set(decontam.OPENERS.split())) <= 200 and len(set(decontam.NUMBER_WORDS.split())) <= 100


def test_clashing_names_and_matching_items(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, ITEM), (None, ITEM.replace("Tom", "Mary"))], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    for name in ("k1", "k2", "t", "raw", "size", "hash", "at", "place", "w", "item_text", "print_", "shift", "n"):
        docs, items = docs.withColumn(name, F.lit(name)), items.withColumn(name, F.lit(name))
    assert sorted((str(r["doc_id"]), r["item_id"], r["leaked"]) for r in decontam.leaks(docs, items).collect()) == [("1", 7, True), ("None", 7, True)]
