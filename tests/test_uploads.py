"""Keyed tables of change files, and uploads that can be searched once their batch is done."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import ingest as I
from quarry.sources.keyed import KeyedTable
from quarry.streaming.uploads import UploadIndex

PROVIDER = I.hashing_embedder(32)


def files_under(path):
    return {os.path.join(a, f): os.path.getsize(os.path.join(a, f)) for a, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "id int, t string")
    assert table.read() is None
    table.write(0, frame((1, "a"), (2, "b"), (2, "b2"), (4, "d"), (None, "n")))
    table.write(1, frame((2, "c"), (3, "x")), deleted=spark.createDataFrame([(4,), (9,)], "id int"))
    want = [(1, "a"), (2, "c"), (3, "x")]
    good = lambda: [r for r in sorted(((r["id"], r["t"]) for r in table.read().collect() if r["id"] is not None))]
    assert good() == want
    table.write(1, frame((2, "c"), (3, "x")), deleted=spark.createDataFrame([(4,)], "id int"))  # the same batch again
    assert good() == want
    table.compact()
    assert good() == want and [f.name for f in (tmp_path / "t/changes").iterdir() if f.is_dir()] == []
    table.write(1, frame((2, "c"), (3, "x")))  # a batch that the base holds already
    table.write(2, frame((1, "z")), deleted=spark.createDataFrame([(3,)], "id int"))
    assert good() == [(1, "z"), (2, "c")]
    table.compact()
    table.compact()
    assert good() == [(1, "z"), (2, "c")] and len(list((tmp_path / "t/base").iterdir())) == 1


def test_a_write_is_as_large_as_its_batch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"))
    table.write(0, spark.range(50_000).select("id", F.sha1(F.col("id").cast("string")).alias("t")))
    before = files_under(tmp_path)
    table.write(1, spark.createDataFrame([(7, "new")], "id long, t string"))
    new = {f: n for f, n in files_under(tmp_path).items() if f not in before}
    assert {f: n for f, n in files_under(tmp_path).items() if f in before} == before and sum(new.values()) < 0.01 * sum(before.values())
    assert table.read().filter("id = 7").first()["t"] == "new" and table.read().count() == 50_000


@pytest.fixture
def index(spark, tmp_path):
    return UploadIndex(spark, str(tmp_path / "index"), PROVIDER, 32, chunk_size=60, chunk_overlap=10)


def uploads(spark, *rows):
    return spark.createDataFrame([(n, None if c is None else bytearray(c, "utf-8")) for n, c in rows], "filename string, content binary")


LONG = " ".join(f"word{i % 37}" for i in range(150))


def test_uploads_are_searchable_at_once(spark, index):
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame([(1, [0.0] * 32)], "query_id int, query_vec array<double>"))
    index.add(0, uploads(spark, ("a b.txt", "Liquidity coverage ratio is one hundred percent."), ("x.md", "# Title\n\n" + LONG), ("p.html", "<title>T</title><p>Deposits are insured.</p>"), ("no.exe", "x"), (" ", "x"), ("e.txt", ""), ("blank.txt", " \n "), ("n.txt", None), ("bad.pdf", "no pdf")))
    ledger = {r["filename"]: r.asDict() for r in index.ledger.read().collect()}
    problems = {k: v["problem"] for k, v in ledger.items()}
    assert problems == {"a_b.txt": None, "x.md": None, "p.html": None, "no.exe": "UNSUPPORTED_FORMAT", "": "MISSING_NAME", "e.txt": "EMPTY_FILE", "blank.txt": "EMPTY_CONTENT", "n.txt": "EMPTY_FILE", "bad.pdf": "CORRUPT_PDF"}
    assert ledger["x.md"]["records_indexed"] == 3 and ledger["a_b.txt"]["status"] == "success" and ledger["a_b.txt"]["file_size_bytes"] == 48
    records = index.records.read()
    assert records.filter("filename = 'x.md'").agg(F.sort_array(F.collect_list("chunk_index"))).first()[0] == [0, 1, 2]
    ask = lambda text: spark.createDataFrame([(1, PROVIDER([text])[0])], "query_id int, query_vec array<double>")
    assert index.search(ask("Liquidity coverage ratio"), 1).first()["filename"] == "a_b.txt"
    index.add(1, uploads(spark, ("a b.txt", "Cyber incidents are reported."), ("x.md", "short now")))
    assert index.search(ask("Cyber incidents reported"), 1).first()["document"].startswith("Cyber")
    after = {r["filename"]: r["n"] for r in index.records.read().groupBy("filename").agg(F.count("*").alias("n")).collect()}
    assert after == {"a_b.txt": 1, "x.md": 1, "p.html": 1}  # the chunks that the longer text had are gone


def test_a_stream_of_uploads_and_its_replay(spark, index, tmp_path):
    for k, rows in enumerate([[("a.txt", "first text here"), ("b.txt", LONG)], [("a.txt", "second text here"), ("c.txt", "third one")]]):
        uploads(spark, *rows).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        files = spark.readStream.schema("filename string, content binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        index.stream(files, str(tmp_path / "cp")).awaitTermination()
    state = lambda: sorted((r["filename"], r["chunk_index"], r["document"]) for r in index.records.read().collect())
    now = state()
    assert [r[0] for r in now] == ["a.txt", "b.txt", "b.txt", "b.txt", "c.txt"] and now[0][2] == "second text here"
    index.add(1, uploads(spark, ("a.txt", "second text here"), ("c.txt", "third one")))  # the batch runs again
    assert state() == now and index.ledger.read().count() == 3
    index.records.compact()
    assert state() == now


def test_a_failing_provider_leaves_a_reason(spark, tmp_path):
    def failing(texts):
        raise ConnectionError("down")

    index = UploadIndex(spark, str(tmp_path / "i"), failing, 32)
    index.provider = failing
    import quarry.streaming.uploads as U

    slow = U.embed
    try:
        U.embed = lambda chunks, provider: slow(chunks, provider, attempts=1)
        index.add(0, uploads(spark, ("a.txt", "text")))
    finally:
        U.embed = slow
    (row,) = index.ledger.read().collect()
    assert (row["status"], row["problem"], row["records_indexed"]) == ("refused", "NO_RECORDS", 0) and index.records.read().count() == 0


def test_pages_query(spark):
    from quarry.plans.index import upload_to_searchable

    d = "/root/testdata/sf0.001"
    rows = upload_to_searchable(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/pages.parquet").count() == len({r["filename"] for r in rows})
    asked = [r for r in rows if r["found"] is not None]
    assert asked and all(r["found"] for r in asked) and all(r["records_indexed"] > 0 for r in rows if r["status"] == "success")
