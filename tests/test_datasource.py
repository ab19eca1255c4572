"""Document formats as Spark data sources: packing by bytes, pruned files, streams with offsets, subclasses."""

import os

from palimpsest.sources import datasource as D


class Notes(D.DocumentSource):
    suffixes = (".note",)

    @classmethod
    def name(cls):
        return "notes"

    def pages(self, content, name):
        if b"bad" in content:
            raise ValueError("bad note")
        return content.decode().split("|")


def folder(tmp_path, **files):
    for k, (name, text) in enumerate(files.items()):
        p = tmp_path / name.replace("__", ".")
        p.write_text(text)
        os.utime(p, (1000 + k, 1000 + k))
    return str(tmp_path)


def test_pages_of_a_format_of_ones_own(spark, tmp_path):
    where = folder(tmp_path, a__note="one|two", b__note="bad", c__txt="no note", d__note="x" * 50)
    d = D.load(spark, Notes, where)
    got = sorted((os.path.basename(r.path), r.page_index, r.text, r.error) for r in d.collect())
    assert got == [("a.note", 0, "one", None), ("a.note", 1, "two", None), ("b.note", None, None, "ValueError: bad note"), ("d.note", 0, "x" * 50, None)]
    assert {os.path.basename(r.path): (r.length, r.modified.timestamp()) for r in d.collect()} == {"a.note": (7, 1000), "b.note": (3, 1001), "d.note": (50, 1003)}


def test_filters_prune_files_and_partitions(spark, tmp_path):
    where = folder(tmp_path, **{f"f{k}__note": "y" * (10 * k + 1) for k in range(20)})
    # opening a ruled-out file would fail: they are made unreadable as notes
    for k in range(10):
        (tmp_path / f"f{k}.note").write_text("bad" + "y" * (10 * k - 2) if k else "b")
    d = D.load(spark, Notes, where, partitionBytes=100)
    small, large = d.filter("length < 30"), d.filter("length > 100 AND path LIKE '%.note'")
    assert large.filter("error IS NOT NULL").count() == 0 and large.count() == 10
    assert small.rdd.getNumPartitions() < d.rdd.getNumPartitions() and d.rdd.getNumPartitions() > 10
    # filters of one query do not stay for the next
    assert small.count() == 3 and d.count() == 20 and large.count() == 10 and d.count() == 20
    reader = D._Reader(Notes({"path": where, "partitionBytes": "100"}))
    left = list(reader.pushFilters([D.ds.GreaterThan(("length",), 100), D.ds.StringEndsWith(("path",), "9.note"), D.ds.EqualTo(("text",), "x")]))
    assert left == [D.ds.EqualTo(("text",), "x")]
    assert [os.path.basename(f.path) for p in reader.partitions() for f in p.files] == ["f19.note"]


def test_packing():
    files = [D.Listed(k, str(k), n) for k, n in enumerate([50, 50, 1, 500, 20, 80, 1])]
    assert [[f.length for f in p.files] for p in D.packed(files, 100)] == [[50, 50], [1], [500], [20, 80], [1]] and D.packed([], 9) == []


def test_a_stream_of_files(spark, tmp_path):
    """Three triggers' worth of files, a restart, and files that came meanwhile: each is read once."""
    (tmp_path / "in").mkdir()
    where = folder(tmp_path / "in", a__note="1", b__note="2|3", c__note="4", d__note="5")
    D.register(spark, Notes)

    def run():
        s = spark.readStream.format("notes").option("maxFilesPerTrigger", 2).load(where)
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1", "2", "3", "4", "5"]
    (tmp_path / "in" / "e.note").write_text("6")
    os.utime(tmp_path / "in" / "e.note", (5000, 5000))
    assert run() == ["1", "2", "3", "4", "5", "6"]


def test_records(spark, tmp_path):
    where = folder(tmp_path, a__jsonl='{"body": "x"}\n\n{"body": null}\n{"text": "y"}\n')
    assert [r.text for r in D.load(spark, D.Records, where, field="body").collect()] == ["x", "", ""]
