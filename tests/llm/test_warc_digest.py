"""A response without a payload digest keeps its headers."""

from evalweave.llm import warc


def test_null_digest(spark):
    schema = "record_id long, url string, captured_at long, headers map<string,string>, digest string"
    full = [(1, "http://a.org/x", 5, {"etag": '"e"', "content-type": "t"}, None)]
    asked = [(2, "http://a.org/x", 6, {"etag": '"e"'}, None)]
    (row,) = warc.resolve(spark.createDataFrame(full, schema), spark.createDataFrame(asked, schema)).collect()
    assert (row.response_id, row.status, row.digest) == (1, warc.RESOLVED, None)
    assert row.headers == {"etag": '"e"', "content-type": "t"}
