"""Pages that arrive in batches, page files as a data source, positions over files."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from attestry.operators.extract import extract_facts
from attestry.operators.relate import relate
from attestry.sources.datasource import PageSource
from attestry.sources.pages import accepted_files, read_json, read_pdf, stream_json
from attestry.streaming.incremental import add_batch, relate_stream, stored

FILES = [
    {"documents": [{"filename": "one.pdf", "pages": [{"text": "Acme Corp\nNet income was $5 million in FY 2023"}, {"text": "Headcount: 120 employees"}]}]},
    {"documents": [{"filename": "two.pdf", "fileSize": 9, "pages": [{"pageNumber": 7, "text": "Acme Corp\nNet income was $6 million in FY 2023"}]}, {"pages": []}, {"pages": [{"text": "  Other Ltd\nNet income was $5 million in FY 2023 "}]}]},
    {"documents": [{"filename": "three.pdf", "pages": [{"text": "Acme Corp\nNet income was $6.01 million in FY 2023\nHeadcount: 130 employees"}]}]},
]


def put(folder, order):
    folder.mkdir()
    for k in order:
        (folder / f"f{k}.json").write_text(json.dumps(FILES[k]))
    return str(folder)


def told(relationships):
    """Relationships by the documents' names, without regard to which is first."""
    rows = relationships.select("type", "variance_percent", F.sort_array(F.array("a.document_name", "b.document_name")).alias("d"), F.col("a.metric").alias("m"))
    return sorted((r["m"], *r["d"], r["type"], r["variance_percent"]) for r in rows.collect())


def test_documents_of_two_files(spark, tmp_path):
    pages = read_json(spark, put(tmp_path / "in", (0, 1, 2)))
    assert [tuple(r) for r in pages.select("doc_pos", "document_name").distinct().orderBy("doc_pos").collect()] == [(0, "one.pdf"), (1, "two.pdf"), (3, "Document 3"), (4, "three.pdf")]
    found = told(relate(extract_facts(pages)))
    assert ("Net Income", "one.pdf", "two.pdf", "CONTRADICTED", 16.67) in found


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """What one run over all files finds."""
    found = told(relate(extract_facts(read_json(spark, put(tmp_path_factory.mktemp("all") / "in", (0, 1, 2))))))
    assert len(found) > 3
    return found


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_batches_in_any_order(spark, tmp_path, order, whole):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for n, k in enumerate(order):
        (folder / f"f{k}.json").write_text(json.dumps(FILES[k]))
        relate_stream(stream_json(spark, str(folder)), store).awaitTermination()
        assert stored(spark, store, "documents").select("doc_pos").distinct().count() == stored(spark, store, "documents").count()
        if n == 1:  # nothing has come: nothing is repeated
            relate_stream(stream_json(spark, str(folder)), store).awaitTermination()
    assert told(stored(spark, store)) == whole


def test_a_batch_that_runs_again(spark, tmp_path):
    store = str(tmp_path / "store")
    parts = [read_json(spark, put(tmp_path / f"in{k}", (k,))).withColumn("doc_pos", F.col("doc_pos") + 10 * k) for k in range(3)]
    for number, k in enumerate((0, 1, 1, 2)):
        add_batch(parts[k], min(number, 2) if number < 3 else 3, store)  # the third call brings documents that are known
    add_batch(parts[2], 3, store)  # as after a failure
    ids = [r["rel_id"] for r in stored(spark, store).collect()]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert sorted(ids) == sorted(r["rel_id"] for r in relate(extract_facts(one)).collect()) and len(ids) == len(set(ids)) > 3
    with pytest.raises(ValueError):
        stored(spark, store, "others")


def test_page_source(spark, tmp_path):
    folder = put(tmp_path / "in", (0, 1, 2))
    (tmp_path / "in/z.pdf").write_bytes(b"nothing \x00 but (caf\xc3\xa9) Tj here")
    spark.dataSource.register(PageSource)
    for size in (10, 1 << 20):
        pages = spark.read.format("pages").option("partitionBytes", size).load(folder)
        assert pages.rdd.getNumPartitions() == (4 if size == 10 else 1)
        got = sorted((r["doc_pos"] >> 24, r["document_name"], r["page_number"], r["text"]) for r in pages.collect())
        same = read_json(spark, folder + "/*.json").select("document_name", "page_number", "text").collect()
        assert sorted(g[1:] for g in got if g[1] != "z.pdf") == sorted(map(tuple, same)) and (3, "z.pdf", 1, "café") in got
    assert told(relate(extract_facts(pages))) == told(relate(extract_facts(read_json(spark, folder + "/*.json"))))
    narrow = spark.read.format("pages").option("columns", "document_name, page_number").load(folder)
    assert narrow.columns == ["document_name", "page_number"] and narrow.count() == 6
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("pages").option("columns", "color").load(folder)
    assert read_pdf(spark, folder).first()["text"] == "café"


def test_first_of_each_name(spark):
    files = spark.createDataFrame([("a.pdf", 5, 2, "late"), ("a.pdf", 6, 1, "early"), ("b.txt", 5, 0, "")], "name string, size long, place int, note string")
    assert [(r["name"], r["note"]) for r in accepted_files(files).collect()] == [("a.pdf", "early")]
