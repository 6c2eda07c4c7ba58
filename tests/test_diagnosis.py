import http.server
import os
import threading

import pytest
from pyspark.sql import functions as F

from quarry import build_plan
from quarry.explore import diagnosis
from quarry.sources import http as web
from quarry.sources.tables import open_table


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "t.parquet")
    rows = spark.range(8000).select(F.col("id").alias("n"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("m"), F.concat(F.lit("k"), F.col("id") % 5).alias("k"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") / 1000).cast("int")).alias("day"), F.when(F.col("id") < 0, 1).alias("nothing"))
    rows.repartitionByRange(8, "n").write.parquet(path)
    return path


def filters(*specs):
    return build_plan(filters=[dict(zip(("column", "op", "value", "value2"), s, strict=False)) for s in specs]).filters


def test_pruning(spark, files):
    df = spark.read.parquet(files)
    asked = filters(("n", "<", 1500), ("m", ">", 990), ("n", "between", 100, 200), ("n", "in", [5, 7999]), ("k", "like", "k"), ("k", "=", "zzz"), ("day", ">=", "2026-01-07"), ("n", "!=", 3), ("nothing", "=", 1), ("n", "in", []))
    report = {r["filter"]: r for r in diagnosis.pruning_report(df, asked).collect()}
    assert [report[i].row_groups for i in range(10)] == [8] * 10
    sizes = sorted((int(r.low), int(r.high)) for r in spark.read.parquet(files).groupBy(F.input_file_name()).agg(F.min("n").alias("low"), F.max("n").alias("high")).collect())
    assert report[0].skipped == sum(low >= 1500 for low, _ in sizes) >= 5
    assert report[1].skipped == 0 and report[1].overlap > 0.95 and report[0].overlap < 0.3
    assert report[2].skipped >= 6 and report[3].skipped == 6 and report[4].skipped == 0 and report[5].skipped == 8 and report[5].rows_skipped == 8000
    assert report[6].skipped >= 4 and report[7].skipped == 0 and report[8].skipped == 0 and report[9].skipped == 8
    assert tuple(diagnosis.selectivity(df, asked[:3]).collect()[0]) == (8000, 1500, 72, 101, df.where("n BETWEEN 100 AND 200 AND m > 990").count())
    assert diagnosis.distinct_values(df, "k") == 5


def test_run_statistics(spark, files):
    table = open_table(spark, files)
    told = diagnosis.run_statistics(table.sql("SELECT k, COUNT(*) AS c FROM t WHERE n < 1500 GROUP BY k ORDER BY c DESC LIMIT 3"))
    assert told["rows"] == 3 and told["seconds"] > 0
    scans = [s for s in told["steps"] if "numFiles" in s["metrics"]]
    assert len(scans) == 1 and scans[0]["metrics"]["numFiles"] == 8 and 1500 <= scans[0]["metrics"]["numOutputRows"] < 8000
    assert any("Exchange" in s["operator"] for s in told["steps"])


class Handler(http.server.SimpleHTTPRequestHandler):
    ranges = True
    asked = []

    def log_message(self, *args):
        pass

    def do_HEAD(self):
        self.answer(False)

    def do_GET(self):
        self.answer(True)

    def answer(self, body):
        path = self.translate_path(self.path)
        if not os.path.exists(path):
            return self.send_error(404)
        data = open(path, "rb").read()
        wanted = self.headers.get("Range")
        if wanted and self.ranges:
            low, high = map(int, wanted.removeprefix("bytes=").split("-"))
            self.send_response(206)
            part = data[low : high + 1]
            Handler.asked.append(len(part))
        else:
            self.send_response(200)
            part = data
        if self.ranges:
            self.send_header("Accept-Ranges", "bytes")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        if body:
            self.wfile.write(part)


@pytest.fixture(scope="module")
def server(files):
    handler = lambda *a: Handler(*a, directory=files)
    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}/"
    running.shutdown()


@pytest.mark.parametrize("ranges", [True, False])
def test_http_source(spark, files, server, monkeypatch, ranges):
    monkeypatch.setattr(web, "WHOLE_BYTES", 0)
    monkeypatch.setattr(Handler, "ranges", ranges)
    names = sorted(f for f in os.listdir(files) if f.endswith(".parquet"))
    urls = [server + f for f in names]
    got = web.read_http(spark, urls, ["k", "n"])
    assert got.columns == ["k", "n"] and sorted(map(tuple, got.collect())) == sorted((f"k{i % 5}", i) for i in range(8000))
    assert web.read_http(spark, urls[0]).schema.simpleString() == spark.read.parquet(files).schema.simpleString()
    one = web.RangeFile(urls[0])
    whole = open(os.path.join(files, names[0]), "rb").read()
    assert one.read(4) == whole[:4] and one.seek(-4, os.SEEK_END) == len(whole) - 4 and one.read() == whole[-4:] and one.read(3) == b""
    assert open_table(spark, urls[0]).df.count() > 0
    if ranges:
        assert 4 in Handler.asked
    with pytest.raises(OSError):
        web.RangeFile(server + "nothing.parquet")
