from pathloom.llm import decontaminate as D

ITEM = "In 2004 the farmer called Alice Smith bought 12 apples for 3 dollars and then sold 12 pears to old Bob for 9 dollars."
ITEMS = [(1, ITEM), (2, "Short question here"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven")]


def found(spark, texts, items=ITEMS, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS `text.x`")
    rows = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), **how).collect()
    return {r.doc_id: [h.item_id for h in r.hits] for r in rows}


def test_words_templates_and_slots(spark):
    texts = [
        f"Before that. {ITEM} And after", ITEM.upper(), f"x {ITEM.lower()} y",
        "In 1999 the farmer called Carol bought 7 apples for 5 dollars and then sold 7 pears to old Dave Jones for 8 dollars.",
        "In 1999 the farmer called Carol bought 7 apples for 5 dollars and then sold 6 pears to old Dave Jones for 7 dollars.",
        "The farmer bought apples and then sold pears.", None, "", "a short question here it is", "zero one two three four five six seven eight nine ten eleven twelve", "apples " * 40_000 + ITEM,
    ]
    want = {0: [1], 1: [1], 2: [1], 3: [1], 5: [], 6: [], 7: [], 8: [2], 9: [5, 5], 10: [1]}
    got = found(spark, texts)
    assert {k: v for k, v in got.items() if k != 4} == want and got[4] == []
    assert found(spark, texts, lot_chars=30) == got  # many lots
    assert found(spark, []) == {} and found(spark, texts, items=[])[0] == []


def test_query_against_brute_force(spark, sf):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, " ".join(words(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in docs for i, t in items if f" {t} " in f" {' '.join(words(r.text))} "}
    rows = D.op7_decontamination(spark, sf).collect()
    assert want and {(r.doc_id, r.item_id) for r in rows} == want


def test_clean_keeps_columns(spark, odd_docs):
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    out = D.clean(odd_docs, items)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count() - 5


def test_windows_of_all_alignments_count_together(spark):
    words = [f"w{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(100)] + [f"v{c}" for c in "abcdefghijklmnopqrst"]
    short, long = words[:30], words
    items = [(1, " ".join(short)), (2, " ".join(f"x{w}" for w in long))]
    texts = [
        " ".join([*short[:15], "inserted", *short[15:]]), " ".join([*short[:14], *short[15:]]),
        " ".join(f"x{w}" for w in long[20:70]), " ".join(f"x{w}" for w in long[20:45]), " ".join(short[:12]),
    ]
    assert found(spark, texts, items=items) == {0: [1], 1: [1], 2: [2], 3: [], 4: []}


def test_dense_slots_and_forward_mapping(spark):
    items = [
        (1, "Add 12, 7, 3 and 9."), (2, "the shop sold 12 apples for 3 dollars in the morning"),
        (3, "We sell 3 apples 4 pears 5 plums 6 figs 7 limes 8 kiwis 9 dates today"),
    ]
    texts = [
        "Add 4, 8, 1 and 2.", "the shop sold 5 apples for 5 dollars in the morning", "so Add 12, 7, 3 and 9.",
        "We sell 9 apples 8 pears 7 plums 6 figs 5 limes 4 kiwis 3 dates today", "Add 4 and 8.", "the shop sold 5 apples",
    ]
    assert found(spark, texts, items=items) == {0: [1], 1: [2], 2: [1], 3: [3], 4: [], 5: []}


def test_names_that_begin_sentences(spark):
    items = [
        (1, "Alice bought 12 apples for 3 dollars. Bob sold 9 pears to Carol."), (2, "Peter has seven old red bikes."),
        (3, "In the evening old McDonald gave the whole farm to young O'Neil for nothing."), (4, "The man is here"),
    ]
    texts = [
        "Dora bought 7 apples for 5 dollars. Erik sold 4 pears to Fay.", "Maria has seven old red bikes.", "It was said that Maria has seven old red bikes.",
        "In the evening old Smith gave the whole farm to young MacArthur for nothing.", "This man is here", "Dora bought apples. Erik sold 4 pears.", "Maria has seven new red bikes.",
        "When Dora bought 7 apples for 5 dollars. Erik sold 4 pears to Fay.",
    ]
    assert found(spark, texts, items=items) == {0: [1], 1: [2], 2: [2], 3: [3], 4: [], 5: [], 6: [], 7: [1]}
