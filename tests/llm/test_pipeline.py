import corpus_pipeline


def test_stages_in_a_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    before = docs.count()
    from huddle.llm.common import written
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "t")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            now = docs.count()
            assert 0 < now <= before
            before = now
        if name == "quality classifier":
            junk = spark.read.parquet(f"{sf}/labels.parquet").join(docs, "doc_id").groupBy("quality").count().collect()
            counts = {r["quality"]: r["count"] for r in junk}
            total = {r["quality"]: r["count"] for r in spark.read.parquet(f"{sf}/labels.parquet").groupBy("quality").count().collect()}
            assert counts.get(1, 0) >= 0.97 * total[1] and counts.get(0, 0) <= 0.2 * total.get(0, 0) + 1
    assert docs.agg({"doc_id": "max"}).first()[0] is not None
    assert docs.select("doc_id").distinct().count() == before


def test_awkward_rows(spark, docs, none, sf):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, plain.filter("false")):
        now = start
        from huddle.llm.common import written
        for _, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, sf), "t")
        assert now.count() >= (1 if start is plain else 0)


def test_one_of_each_group_stays(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, plain, "").collect()]
    assert got.count(100) == 1 and 101 not in got and 102 not in got and got.count(5) == 1 and got.count(None) == 2


def test_near_copies_from_080_go(spark):
    """200 different words with one replaced in the middle share 191 of 201 runs of five; with five apart, 171 of 221; with four, 176 of 216."""
    rows = []
    for i, at in enumerate(([], [20, 60, 100, 140], [20, 60, 100, 140, 180])):
        rows.append((i, " ".join(f"x{i}" if k in at else f"w{k}" for k in range(200)), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == [0, 2]                                                # 0.815 and 0.774


def test_rows_of_one_id_are_told_by_text(spark):
    """Two texts of one id both stay, unless one is a copy of another document's."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (1, text("a")), (2, text("b")), (3, text("c")), (0, text("c")), (4, None), (4, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text or "", r.text is None) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == [(0, text("c"), False), (1, text("a"), False), (1, text("b"), False), (4, "", False), (4, "", True)]
