"""What lies beyond a bound: long texts in a sample, deep pages, long ways up, and runs that are repeated."""

import tempfile

from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, extraction, quality, urlfilter


def test_a_text_over_the_bound_leaves_the_rest_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 40_000)
    rows = [(k, ("good prose about rivers " if k % 2 else "buy now cheap cheap ") * (3000 if k % 9 == 0 else 5)) for k in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert model is not None
    scored = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert len(scored) == 59 and min(scored[k] for k in scored if k % 2) > max(scored[k] for k in scored if not k % 2)


def test_ways_up_of_any_length(spark):
    links = ["../" * 9 + "x", "a/../../b/./c?d=../e", "/p/q/..", "../..", "../../../../../..", "./", "/a/b/../../../../c#../x", "?q=/../z", "k/./l"]
    df = spark.createDataFrame([(k,) for k in links], "link string").withColumn("base", F.lit("http://a.com/1/2/3/4/5/6/7/8/9/p"))
    got = {r.link: r.u for r in df.select("link", urlfilter.absolute(F.col("link"), F.col("base")).alias("u")).collect()}
    deep = "http://a.com/1/2/3/4/5/6/7/8/9/"
    assert got == {
        links[0]: "http://a.com/x", links[1]: "http://a.com/1/2/3/4/5/6/7/8/b/c?d=../e", links[2]: "http://a.com/p/", links[3]: "http://a.com/1/2/3/4/5/6/7/",
        links[4]: "http://a.com/1/2/3/", links[5]: deep, links[6]: "http://a.com/c#../x", links[7]: deep + "p?q=/../z", links[8]: deep + "k/l",
    }


def test_end_tags_of_elements_that_are_too_deep_close_nothing_else(spark):
    for inner in (10, 600, 2000):
        page = "<body><div><aside>" + "<div>" * inner + "hidden" + "</div>" * inner + "more hidden</aside></div><p>" + "main text of the page " * 9 + "</p></body>"
        df = spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string")
        assert extraction.extract_pages(df).first()["text"] == ("main text of the page " * 9).strip()


def test_a_run_may_be_repeated(spark):
    home = tempfile.mkdtemp(prefix="spark-")
    source = f"{home}/docs"
    spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string").write.parquet(source)
    docs = spark.read.parquet(source)
    first = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, state_dir=f"{home}/state").collect())
    again = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, state_dir=f"{home}/state").collect())
    assert first == again == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    spark.createDataFrame([(9, "B")], "doc_id long, text string").write.parquet(f"{home}/more")
    later = exact_dedup.exact_dedup(spark.read.parquet(f"{home}/more"), state_dir=f"{home}/state").collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in later] == [(9, 9, 2)]
