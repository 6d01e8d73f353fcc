from catsim.llm import neardup


def test_keep_one_keeps_different_texts_of_one_id(spark):
    near = " ".join(f"word{i}" for i in range(60))
    alone = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(1, near), (1, near), (1, alone[0]), (2, near + " more"), (2, alone[1]), (3, near), *((4, t) for t in alone[2:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in neardup.keep_one(df).collect())
    assert got == sorted([(1, near), (1, alone[0]), (2, alone[1]), *((4, t) for t in alone[2:])])
