from pyspark.sql import functions as F

from loomgraph.llm import decontaminate

from .conftest import ODD

ITEM = "A train leaves the old station at Springfield with 120 passengers and travels 45 km before it meets Alice near the river bridge today"
SHORT = "please compute quickly now"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, key string")


def found(df):
    return {(r.doc_id, r.item_id): r for r in df.collect()}


def test_leaks(spark, documents):
    other = ITEM.replace("120", "7,500.5").replace("45 km", "3 miles").replace("Springfield", "Riverton").replace("Alice", "Robert")
    jumble = "A train leaves the old station at 5 with Bob passengers and travels Alice km before it meets 3 near"
    mixed = "Alice meets Alice and Alice then Robert again at the place where Robert stood"
    same = [(10, "Intro words. " + ITEM + " and the rest."), (11, "Before. " + other + "."), (12, "nothing of this kind at all in the text of this document here"), (13, ITEM.upper()), (14, " ".join(ITEM.split()[:9])), (15, jumble), (16, mixed)]
    got = found(decontaminate.contaminated(documents(ODD + same, extra=True), items(spark, [(1, ITEM), (2, None), (3, ""), (4, SHORT), (5, SHORT)])))
    assert {k for k in got} >= {(10, 1), (11, 1)}
    assert not got[(10, 1)].reparameterised and got[(11, 1)].reparameterised
    assert not {(i, 1) for i in (12, 14, 15, 16)} & set(got)
    assert got[(10, 1)].coverage == 1.0


def test_slots_must_agree(spark, documents):
    item = "Anna gave the red apples to Bernard and then Bernard gave the green pears to Anna again"
    good = "Yesterday Clara gave the red apples to Dennis and then Dennis gave the green pears to Clara again"
    bad = "Yesterday Clara gave the red apples to Dennis and then Edward gave the green pears to Fiona again"
    got = found(decontaminate.contaminated(documents([(1, good), (2, bad)]), items(spark, [(1, "Today " + item)]), coverage=0.9))
    assert set(got) == {(1, 1)}


def test_join_without_the_filter(spark, documents, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a = found(decontaminate.contaminated(docs, bench))
    b = found(decontaminate.contaminated(docs, bench, filter_size=0))
    assert a == b and len(a) > 0


def test_planted_passages(spark, sf):
    """Every document that holds an item word for word is found."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {(i, r.item_id) for r in bench.collect() for i, t in texts.items() if r.text and r.text in t}
    got = found(decontaminate.contaminated(docs, bench))
    assert want <= set(got) and want


def test_empty(spark, documents):
    assert decontaminate.contaminated(documents([]), items(spark, [(1, ITEM)])).count() == 0
    assert decontaminate.contaminated(documents([(1, ITEM)]), items(spark, [])).count() == 0
    twice = decontaminate.contaminated(documents([(1, "X. " + ITEM), (1, "X. " + ITEM), (None, "X. " + ITEM)]), items(spark, [(1, ITEM)])).select(F.coalesce("doc_id", F.lit(-1)).alias("d")).collect()
    assert sorted(r.d for r in twice) == [-1, 1]


def test_other_lengths_of_slots_and_other_case(spark, documents):
    longer = ITEM.replace("Springfield", "New York").replace("120", "twenty five").replace("Alice", "Mary Ann")
    inserted = " ".join([*ITEM.split()[:12], "quite", "slowly", *ITEM.split()[12:]])
    rows = [(1, "Intro words. " + longer + " and the rest."), (2, ITEM.upper()), (3, ITEM.lower()), (4, "Then " + inserted), (5, " ".join(ITEM.split()[12:] + ITEM.split()[:12])), (6, "so 1 2 3 4 5 6 7 8 9 it is")]
    got = found(decontaminate.contaminated(documents(rows), items(spark, [(1, "Today " + ITEM), (2, "1 2 3 4 5 6 7 8 9")])))
    assert set(got) >= {(1, 1), (2, 1), (3, 1), (4, 1), (6, 2)} and got[(1, 1)].coverage > 0.9 and got[(1, 1)].reparameterised
    assert not got[(2, 1)].reparameterised and got[(2, 1)].coverage > 0.8 and got[(4, 1)].coverage > 0.8
    assert (5, 1) not in got or got[(5, 1)].coverage < 0.6


def test_upper_case_copy(spark, documents):
    """Document 13 of test_leaks."""
    assert set(found(decontaminate.contaminated(documents([(13, ITEM.upper())]), items(spark, [(1, ITEM)])))) == {(13, 1)}
