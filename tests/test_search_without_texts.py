"""An index is searched by vectors alone; records' other columns meet the rows that were found."""

import quarry.streaming.uploads as U
from quarry.session import fresh_folder


def test_search_ranks_vectors_alone(spark, monkeypatch):
    index = U.UploadIndex(spark, fresh_folder(spark, "narrow"), lambda texts: [[1.0] * 4 for _ in texts], 4)
    rows = [(f"c{i}", [1.0, float(i), 0.0, 0.0], f"text {i}", "f.txt", "a" if i % 2 else "b") for i in range(8)]
    index.records.write(0, spark.createDataFrame(rows, "id string, embedding array<double>, document string, filename string, kind string"))
    seen, ranked = [], U.best_rows
    monkeypatch.setattr(U, "best_rows", lambda q, c, *a, **more: seen.append(c.columns) or ranked(q, c, *a, **more))
    asked = spark.createDataFrame([(1, [1.0, 3.0, 0.0, 0.0], "b", "said")], "query_id int, query_vec array<double>, wanted string, note string")
    (plain,) = index.search(asked, 1, carry=("note",)).collect()
    (same,) = index.search(asked, 1, match=("wanted", "kind")).collect()
    assert (plain["id"], plain["document"], plain["kind"], plain["note"], plain["rank"]) == ("c3", "text 3", "a", "said", 1) and (same["id"], same["document"], same["kind"]) == ("c4", "text 4", "b")
    assert seen == [["id", "vec"], ["id", "vec", "kind"]]
