"""Record ids of text ids: unlike ids have unlike records, and come back as they were."""

from pyspark.sql import functions as F

from courtside.llm.warc import id_of, read_warc, record_urn, resolve_revisits, write_warc

IDS = [None, "null", "", "a b", "a_b", "a+b", "a%20b", "<x>", "y\r\nz", "ä€", "a/b?c#d"]


def test_ids_are_told_apart_and_come_back(spark):
    rows = spark.createDataFrame([(i,) for i in IDS], "id string").select("id", record_urn(F.col("id")).alias("urn"))
    got = rows.select("id", "urn", id_of(F.col("urn")).alias("back")).collect()
    assert len({r["urn"] for r in got}) == len(IDS)
    assert all(r["back"] == r["id"] and not set(r["urn"][1:-1]) & set("<> \r\n") for r in got)
    assert spark.createDataFrame([("other",)], "u string").select(id_of(F.col("u"))).first()[0] is None


def test_archives_keep_text_ids(spark, tmp_path):
    records = spark.createDataFrame([(i, "http://h/", f"page {k % 3}") for k, i in enumerate(IDS)], "page_id string, url string, html string")
    write_warc(records, f"file://{tmp_path}/w", "page_id", "url", "html")
    got = resolve_revisits(read_warc(spark, f"file://{tmp_path}/w")).select(id_of(F.col("record_id")).alias("id"), "record_type", id_of(F.col("refers_to_id")).alias("to")).collect()
    assert {r["id"] for r in got} == set(IDS) and len(got) == len(IDS)
    for r in got:
        group = [i for k, i in enumerate(IDS) if k % 3 == IDS.index(r["id"]) % 3]
        keep = max(i for i in group if i is not None)
        assert (r["record_type"], r["to"]) == (("response", None) if r["id"] == keep else ("revisit", keep))
