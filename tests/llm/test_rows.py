import sparkseries.llm.decontaminate as decontaminate
import sparkseries.llm.simhash as simhash

PROSE = ["the cat sat on a red mat by the old door of the house", "every ship that left port in march came back with salt and iron", "seven tall masons built one long wall out of flat grey stone"]
ITEM = "a b c d e f g h i"


def rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_leaks_of_null_and_shared_ids(spark):
    """One leaking row takes no other row with it, and parts in several rows are no leak."""
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = [(None, f"x {ITEM} y"), (None, PROSE[0]), (None, "a b c d e f g"), (None, "d e f g h i"), (None, None), (5, PROSE[1]), (5, f"z {ITEM}"), (6, "a b c d e f g"), (6, "d e f g h i"), (7, f"x {ITEM} y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone = {(None, f"x {ITEM} y"), (5, f"z {ITEM}"), (7, f"x {ITEM} y")}
    assert rows(decontaminate.drop_leaking(df, bench)) == rows(spark.createDataFrame([d for d in docs if d not in gone], df.schema))


def test_copies_of_shared_ids(spark):
    """Unrelated texts under one id all stay; a class keeps one row, once, and that of its least id."""
    docs = [(5, PROSE[0]), (5, PROSE[1]), (5, PROSE[1]), (3, PROSE[2]), (8, PROSE[2]), (8, PROSE[0]), (2, None), (2, ""), (9, None), (9, PROSE[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(simhash.keep_one_of_each(df)) == sorted([(False, 2, ""), (False, 3, PROSE[2]), (False, 5, PROSE[0]), (False, 5, PROSE[1])])


def test_representative_is_of_its_class(spark):
    """Id 5 stands for the copies of one text only; its other text is a copy of a lower id's."""
    df = spark.createDataFrame([(5, PROSE[0]), (7, PROSE[0]), (5, PROSE[1]), (1, PROSE[1])] * 3, "doc_id long, text string")
    assert rows(simhash.keep_one_of_each(df)) == [(False, 1, PROSE[1]), (False, 5, PROSE[0])]
