"""State tables, streams with state, run-wide budgets and collections: repeated, torn, late and dealt in other ways."""

import json
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest import config as settings
from palimpsest.errors import CheckpointError
from palimpsest.operators import assemble, costing, prefix, store
from palimpsest.pipeline import Pipeline
from palimpsest.streaming import ingest, stateful

SHAPE = "path string, page_index int, sha256 string, text string"


def table(spark, tmp_path, **kw):
    return store.StateTable(spark, str(tmp_path / "t"), ["path", "page_index"], ["path"], 4, **kw)


def rows_of(t):
    return sorted((tuple(r) for r in t.read().collect()), key=str)


def test_merge_keeps_the_last_row_of_each_key(spark, tmp_path):
    t = table(spark, tmp_path, generation="sha256")
    assert t.read() is None
    df = lambda *rows: spark.createDataFrame(rows, SHAPE)
    assert t.merge(df(("a", 0, "x", "1"), ("a", 1, "x", "2"), ("b", 0, "y", "3"), (None, None, "z", "4")), "w", 0)
    assert t.merge(df(("a", 1, "x", "5"), ("c", 0, "c", "6"), (None, None, "z", "7")), "w", 1)
    assert rows_of(t) == sorted([("a", 0, "x", "1"), ("a", 1, "x", "5"), ("b", 0, "y", "3"), ("c", 0, "c", "6"), (None, None, "z", "7")], key=str)
    # other content of a file: its old pages go; a repeated or an older merge changes nothing; another writer's counts
    assert t.merge(df(("a", 0, "new", "8")), "w", 2) and not t.merge(df(("a", 0, "new", "9")), "w", 2) and not t.merge(df(("b", 0, "y", "9")), "w", 1)
    assert t.merge(df(("b", 0, "y", "10")), "other", 0) and t.merge(df(), "w", 3)
    assert rows_of(t) == sorted([("a", 0, "new", "8"), ("b", 0, "y", "10"), ("c", 0, "c", "6"), (None, None, "z", "7")], key=str)
    assert t.vacuum() > 0 and len(rows_of(t)) == 4


def test_latest_row_of_a_merge_counts(spark, tmp_path):
    t = table(spark, tmp_path, latest=["text"])
    t.merge(spark.createDataFrame([("a", 0, "x", "1"), ("a", 0, "x", "3"), ("a", 0, "x", "2")], SHAPE), "w", 0)
    assert rows_of(t) == [("a", 0, "x", "3")]


def test_a_crash_before_the_commit_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([("a", 0, "x", "1")], SHAPE), "w", 0)
    news = spark.createDataFrame([("a", 0, "x", "2"), ("b", 0, "x", "3")], SHAPE)
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lambda c: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.merge(news, "w", 1)
    assert rows_of(t) == [("a", 0, "x", "1")]
    assert t.merge(news, "w", 1) and rows_of(t) == [("a", 0, "x", "2"), ("b", 0, "x", "3")]


def test_a_slower_writer_starts_over(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    real, raced = t._commit, []

    def late(commit):
        if not raced:
            raced.append(other.merge(spark.createDataFrame([("a", 1, "x", "fast")], SHAPE), "fast", 0))
        return real(commit)

    monkeypatch.setattr(t, "_commit", late)
    assert t.merge(spark.createDataFrame([("a", 0, "x", "slow")], SHAPE), "slow", 0)
    assert rows_of(t) == [("a", 0, "x", "slow"), ("a", 1, "x", "fast")] and t.head().version == 2
    monkeypatch.setattr(t, "_commit", lambda c: False)
    with pytest.raises(CheckpointError):
        t.merge(spark.createDataFrame([("a", 0, "x", "z")], SHAPE), "slow", 1, attempts=2)


def _epub(path, chapters):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o.opf"/></rootfiles></container>')
        z.writestr("o.opf", f'<package><metadata/><manifest>{"".join(f"<item id=\'i{k}\' href=\'{k}.xhtml\'/>" for k in range(len(chapters)))}</manifest><spine>{"".join(f"<itemref idref=\'i{k}\'/>" for k in range(len(chapters)))}</spine></package>')
        for k, c in enumerate(chapters):
            z.writestr(f"{k}.xhtml", f"<html><body><p>{c}</p></body></html>")


def test_a_second_run_repeats_no_page(spark, tmp_path):
    """A file with a blank page stays pending, run after run; its other pages stay as they are, once each."""
    src = tmp_path / "in"
    src.mkdir()
    _epub(src / "a.epub", ["first page text", "", "third page text"])
    (src / "b.txt").write_text("old")
    c = settings.with_values(settings.Config(), {"input_dir": str(src), "output_dir": str(tmp_path / "out"), "input_extensions": "epub,txt"})
    pages = lambda: sorted((r.path.rsplit("/", 1)[1], r.page_index, r.status, r.text) for r in store.pages_table(spark, str(tmp_path / "out")).read().collect())
    Pipeline(spark, c).run()
    first = pages()
    assert [p[1] for p in first if p[0] == "a.epub"] == sorted({p[1] for p in first if p[0] == "a.epub"}) and len(first) >= 3
    Pipeline(spark, c).run()
    assert pages() == first
    (src / "b.txt").write_text("new")
    (src / "c.txt").write_text("more")
    Pipeline(spark, c).run()
    assert [p for p in pages() if p[0] != "a.epub"] == [("b.txt", 0, "extracted", "new"), ("c.txt", 0, "extracted", "more")]
    docs = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()}
    assert docs["a.epub"].document.count("first page text") == 1 and docs["b.txt"].document.endswith("new")


def test_one_file_alone(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a.txt", "b.txt"):
        (src / name).write_text(f"text of {name}")
    p = Pipeline(spark, settings.with_values(settings.Config(), {"input_dir": str(src), "output_dir": str(tmp_path / "out"), "input_extensions": "txt"}))
    assert p.process_one(str(src / "b.txt"))["pages_complete"] == 1
    assert [r.text for r in store.pages_table(spark, str(tmp_path / "out")).read().collect()] == ["text of b.txt"]
    assert p.run()["pages_complete"] == 2


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.txt").write_text(f"text {k}")
    args = (spark, str(src), str(tmp_path / "pages"), str(tmp_path / "cp"))
    first = sorted(r.text for r in ingest.ingest(*args).collect())
    commits = sorted(p for p in Path(tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for p in Path(tmp_path / "cp" / "commits").iterdir():
        if commits[-1].name in p.name:
            p.unlink()  # the batch's end was not recorded: Spark runs it again
    (src / "3.txt").write_text("text 3")
    assert first == ["text 0", "text 1", "text 2"]
    assert sorted(r.text for r in ingest.ingest(*args).collect()) == [*first, "text 3"]


def stream(spark, tmp_path, batches, schema, run, name):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
    q = run(source).writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, spark.read.parquet(f"{tmp_path}/{name}/out").collect()


def at(s):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_breaker_in_any_split(spark, tmp_path):
    rng = random.Random(1)
    calls = [(rng.choice("ab"), at(rng.randint(0, 50)), k, rng.random() < 0.6) for k in range(60)]
    want, run = {}, {"a": 1, "b": 0}
    for e, _, k, failed in sorted(calls, key=lambda c: (c[1], c[2])):
        run[e] = run[e] + 1 if failed else 0
        want[k] = (e, run[e], run[e] >= 3)
    schema, end = "engine string, ts timestamp, seq long, failed boolean", [("end", at(10**7), -1, False)]
    start = spark.createDataFrame([("a", 1)], "engine string, failures long")
    for n in (1, 3):
        rng.shuffle(calls)
        _, got = stream(spark, tmp_path, [*(calls[k::n] for k in range(n)), end], schema, lambda s: stateful.breaker(s, 3, "1 hour", start), f"breaker{n}")
        assert {r.seq: (r.engine, r.failures, r.is_open) for r in got} == want and len(got) == len(want)


def test_breaker_holds_few_of_the_waiting_calls(monkeypatch):
    """Runs merge in levels, stop at the watermark and go on from there; no more than a block of each run is held."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(stateful, "_BLOCK", 4)
    monkeypatch.setattr(stateful, "_SORTED", 2)
    monkeypatch.setattr(stateful, "_RUNS", 3)

    class State(dict):
        exists, get, update = lambda s: "v" in s, lambda s: s["v"], lambda s, v: s.__setitem__("v", v)
        iterator, getValue, updateValue, removeKey = lambda s: iter(list(s.items())), dict.__getitem__, dict.__setitem__, dict.__delitem__

    class Handle:
        timers: list = []
        getValueState = getMapState = lambda s, *_: State()
        listTimers, deleteTimer, registerTimer = lambda s: list(s.timers), lambda s, t: s.timers.remove(t), lambda s, t: t in s.timers or s.timers.append(t)

    class Time:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    rng = random.Random(3)
    calls = [(rng.choice([rng.randint(-5, 300), 100]) * 1000, k - 150, rng.random() < 0.6) for k in range(300)] + [(100_000, None, True), (100_000, 7, False), (100_000, 7, True)]
    want, failures = [], 0
    for _, seq, failed in sorted(calls, key=lambda c: (c[0], c[1] is not None, c[1] or 0, c[2])):
        failures = failures + 1 if failed else 0
        want.append((seq, failures, failures >= 2))
    rng.shuffle(calls)
    b, handle = stateful.Breaker(2), Handle()
    b.init(handle)
    frame = lambda rows: pd.DataFrame({"us": np.array([r[0] for r in rows], "int64"), "seq": np.array([r[1] or 0 for r in rows], "int64"), "named": [r[1] is not None for r in rows], "failed": [r[2] for r in rows]})
    got, held = [], 0
    read, block = [], b._block
    b._block = lambda r, k: read.append(r) or block(r, k)
    for k in range(0, len(calls), 30):
        got += list(b.handleInputRows(("e",), iter([frame(calls[k : k + 17]), frame(calls[k + 17 : k + 30])]), Time(-10)))
    assert not got and len(b.runs) <= 3 * 4 and max(len(v[0]) for v in b.blocks.values()) <= 4 * stateful._CALL.itemsize
    for ms in (50, 100, 101, 400):
        assert b.alarm.handle.timers == [min(v[3] for v in b.runs.values()) // 1000 + 1]
        read.clear()
        parts = b.handleExpiredTimer(("e",), Time(ms), None)
        got.append(next(parts))
        held = max(held, len(read) - len(got[-1]) // 4)  # blocks read for the first rows
        got += list(parts)
    assert not b.runs and not b.blocks and not handle.timers and held <= 3 * 4
    rows = [(None if pd.isna(s) else int(s), int(n), bool(o)) for d in got for s, n, o in zip(d["seq"], d["failures"], d["is_open"], strict=True)]
    assert rows == want


def test_completion_emits_once_and_forgets(spark, tmp_path):
    pages = lambda p, n, ks, s: [(p, k, n, True, at(s + k)) for k in ks]
    batches = [pages("a", 2, [0], 0) + pages("b", 3, [0, 1], 0), pages("a", 2, [0, 1, 1], 5) + pages("c", 1, [0], 9), [("d", 0, 2, False, at(2000))] + pages("a", 2, [1], 10), pages("b", 3, [2], 30_000) + pages("end", 5, [0], 60_000)]
    q, got = stream(spark, tmp_path, batches, "path string, page long, page_count long, is_done boolean, ts timestamp", lambda s: stateful.completions(s, "1 second", 1000_000), "completion")
    rows = sorted((r.path, r.pages_done, r.page_count, r.complete) for r in got)
    assert [r for r in rows if r[0] in "ac"] == [("a", 2, 2, True), ("c", 1, 1, True)]
    # given up for lack of its last page; which, when it comes at last, is a new document's
    assert [r for r in rows if r[0] in "bd"] == [("b", 1, 3, False), ("b", 2, 3, False), ("d", 0, 2, False)]
    # of all documents only the last one is still known
    last = [o for p in q.recentProgress for o in p["stateOperators"]][-1]
    assert last["numRowsTotal"] <= 12, last


def plain_budget(calls, cap):
    spent, out = 0, {}
    for k, e, a in calls:
        ok = spent + e <= cap
        spent += a if ok else 0
        out[k] = (ok, spent)
    return out


@pytest.mark.parametrize("kind", ["few", "many", "falling", "none", "all"])
def test_budget_over_ranges(spark, kind):
    rng = random.Random(kind)
    n = 400
    cost = {"few": lambda k: rng.choice([1, 2, 5, 40]), "many": lambda k: rng.randint(0, 100), "falling": lambda k: n - k, "none": lambda k: 10**6, "all": lambda k: 1}[kind]
    calls = [(k, e := cost(k), rng.randint(0, e) if kind == "many" else e) for k in range(n)]
    cap = sum(c[2] for c in calls) // 3 if kind != "all" else 10**6
    df = spark.createDataFrame([(k, float(e), float(a)) for k, e, a in calls], "k long, e double, a double").repartition(5)
    for parts in (1, 7, 60):
        got = {r.k: (r.admitted, round(r.spent)) for r in costing.admit_run(df, cap, ["k"], "e", "a", parts, unit=1.0).collect()}
        assert got == plain_budget(calls, cap)


def test_budget_edges(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, -5.0, None), (3, 1.0, 1.0)], "k long, e double, a double")
    assert {r.k: (r.admitted, r.spent) for r in costing.admit_run(df, 2.0, ["k"], "e", "a", 3).collect()} == {1: (True, 2.0), 2: (True, 2.0), 3: (False, 2.0)}
    assert costing.admit_run(df.limit(0), 1.0, ["k"], "e", "a", 3).count() == 0


def test_no_window_holds_all_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = prefix.sums_before(prefix.ranges(e, ["ts", "event_id"], 6), {"n": F.lit(1)})
    assert "SinglePartition" not in d._jdf.queryExecution().toString()
    assert [r.n for r in d.orderBy("ts", "event_id").collect()] == list(range(e.count()))


def test_collection_is_written_in_order(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, rng.choice(["", " \n", "é" * rng.randint(1, 9), f"text {k}\nline"])) for k in range(80)]
    df = spark.createDataFrame(docs, "id long, document string").repartition(5)
    kept = [(k, t) for k, t in docs if t.strip()]
    m = sorted(assemble.write_collection(df, ["id"], str(tmp_path / "c"), parts=9).collect(), key=lambda r: r.position)
    parts = sorted(Path(tmp_path / "c").glob("_part=*"), key=lambda p: int(p.name.partition("=")[2]))
    files = [sorted(p.glob("part-*")) for p in parts]
    assert all(len(f) == 1 for f in files) and len(files) > 3
    whole = b"".join(f.read_bytes() for (f,) in files)
    assert whole.decode() == "\n\n---\n\n".join(t for _, t in kept) + "\n"
    assert [whole[r.offset : r.offset + r.bytes].decode() for r in m] == [t for _, t in kept] and [r.id for r in m] == [k for k, _ in kept]


def test_merge_stages_a_file_a_bucket(spark, tmp_path, monkeypatch):
    """Rows are gathered by bucket before they are staged: many tasks do not write a file to each bucket each."""
    staged, real = [], store.StateTable._merged
    monkeypatch.setattr(store.StateTable, "_merged", lambda self, schema, folder, *rest: staged.extend(Path(folder).rglob("*.parquet")) or real(self, schema, folder, *rest))
    news = spark.range(400).repartition(16).selectExpr("concat('f', id) AS path", "0 AS page_index", "'s' AS sha256", "'t' AS text")
    assert table(spark, tmp_path).merge(news, "w", 0) and 4 <= len(staged) <= 8
    assert table(spark, tmp_path).read().count() == 400


def test_a_stream_of_many_small_files_takes_few_tasks(spark, tmp_path, monkeypatch):
    """A batch's files are listed and read by tasks that go by the cores, not by one for each file or 32 of them."""
    src = tmp_path / "in"
    src.mkdir()
    for k in range(300):
        (src / f"{k}.txt").write_text(f"text {k}")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")}
    groups, parts, real = [], [], store.StateTable.merge

    def merge(self, news, *rest):
        groups.append(spark.sparkContext.getLocalProperty("spark.jobGroup.id"))
        parts.append(news.rdd.getNumPartitions())
        return real(self, news, *rest)

    monkeypatch.setattr(store.StateTable, "merge", merge)
    assert ingest.ingest(spark, str(src), str(tmp_path / "pages"), str(tmp_path / "cp")).count() == 300
    cores, known = spark.sparkContext.defaultParallelism, spark.sparkContext.statusTracker()
    stages = [known.getStageInfo(s) for j in known.getJobIdsForGroup(groups[0]) for s in known.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 4 * cores and parts[0] <= cores + 1
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_a_merge_of_new_files_rewrites_nothing(spark, tmp_path, monkeypatch):
    """Rows of other files are added to the buckets; a bucket in many folders is rewritten, and one whose file comes again."""
    t, data = table(spark, tmp_path, generation="sha256"), str(tmp_path / "t" / "data")
    df = lambda k, sha="s": spark.createDataFrame([(f"{k}-{i}", 0, sha, f"{k} {i}") for i in range(20)], SHAPE)
    stored = lambda: spark.read.option("recursiveFileLookup", True).parquet(data).count()
    for k in range(3):
        assert t.merge(df(k), "w", k)
    assert stored() == 60 and t.read().count() == 60
    assert t.merge(df(1, "new").withColumn("more", F.lit(1)), "w", 3)  # a column more, and all pages of these files again
    assert sorted((r.path, r.sha256, r.more) for r in t.read().collect()) == sorted((f"{k}-{i}", "new" if k == 1 else "s", 1 if k == 1 else None) for k in range(3) for i in range(20))
    monkeypatch.setattr(store, "MOST_FOLDERS", 2)
    for k in range(4, 8):
        assert t.merge(df(k), "w", k) and max(map(len, t.head().buckets.values())) <= 2
    assert t.read().count() == 140 and t.vacuum() > 0 and len({r.path for r in t.read().collect()}) == 140


def test_a_ledger_of_one_folder_a_bucket_goes_on(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([("a", 0, "x", "1")], SHAPE), "w", 0)
    (record,) = (tmp_path / "t" / "ledger").glob("0*.json")
    body = json.loads(record.read_text())
    record.write_text(json.dumps(body | {"buckets": {b: f if isinstance(f, str) else f[0] for b, f in body["buckets"].items()}}))
    (tmp_path / "t" / "ledger" / f".{record.name}.crc").unlink(missing_ok=True)
    assert t.merge(spark.createDataFrame([("a", 1, "x", "2")], SHAPE), "w", 1) and rows_of(t) == [("a", 0, "x", "1"), ("a", 1, "x", "2")]
