import json

import pytest

from tidemark.plans.ledgers import Ledger
from tidemark.schema import BAR_COLUMNS, PanelError, check, disjoint_symbols, duplicate_keys
from tidemark.sources import bars as source
from tidemark.sources import rest
from tidemark.sources.sinks import write_bars, write_frame


def test_select_bars(bars, day):
    df = bars({"AAA": [1.0, 2, 3, 4], "BBB": [5.0, 6, 7, 8]})
    got = source.select_bars(df, symbols=[" aaa ", "", "bbb"], start="2024-01-02", end="2024-01-03", columns=["symbol", "close"])
    assert [tuple(r) for r in got.collect()] == [("AAA", 2.0), ("BBB", 6.0), ("AAA", 3.0), ("BBB", 7.0)]
    for broken in (dict(symbols=["  "]), dict(columns=[]), dict(columns=["nope"]), dict(start="2024-01-03", end="2024-01-02"), dict(start="x")):
        with pytest.raises(PanelError):
            source.select_bars(df, **broken)
    assert source.count_bars(df) == 8
    assert [r[0] for r in source.available_symbols(df).collect()] == ["AAA", "BBB"]


def test_date_bounds_reach_the_scan(spark, bars, tmp_path):
    bars({"AAA": [1.0, 2, 3]}).write.parquet(str(tmp_path / "b"))
    plan = source.query_bars(spark, str(tmp_path / "b"), symbols=["AAA"], end="2024-01-02", columns=["symbol", "close"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp)" in plan and "LessThan(timestamp" in plan and "volume" not in plan.split("ReadSchema")[-1]


def test_point_in_time(bars, day):
    df = bars({"AAA": [1.0, 2, 3, 4]})
    assert [r["close"] for r in source.point_in_time(df, as_of="2024-01-03").collect()] == [1, 2, 3]
    assert source.point_in_time(df, as_of="2024-01-03", strict=False).count() == 3
    with pytest.raises(source.LookaheadError, match="2 rows"):
        source.assert_no_lookahead(df, "2024-01-02")
    with pytest.raises(PanelError):
        source.point_in_time(df, as_of="2023-01-01")
    with pytest.raises(PanelError):
        source.point_in_time(df, as_of="2024-01-01", start="2024-01-02")
    with pytest.raises(PanelError, match="duplicate"):
        source.point_in_time(df.union(df), as_of="2024-01-03")
    assert duplicate_keys(df.union(df)).count() == 4
    assert disjoint_symbols(df, bars({"ZZZ": [1.0]})) and not disjoint_symbols(df, df)


def test_check_reports_every_fault(spark, day):
    rows = [(" ", day(0), 1.0), ("A", None, float("nan")), ("A", day(1), -1.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double")
    with pytest.raises(PanelError) as e:
        check(df, prices=["close"])
    assert all(x in str(e.value) for x in ("blank ids", "null times", "non-finite close", "at or below zero"))
    with pytest.raises(PanelError, match="has no close"):
        check(df.selectExpr("'A' AS symbol", "timestamp", "CAST(NULL AS DOUBLE) AS close").where("timestamp is not null"), prices=["close"], key=("symbol", "timestamp"))


def test_sinks(bars, tmp_path):
    df = bars({"aaa": [1.0]})
    write_bars(df, str(tmp_path / "x"))
    assert df.sparkSession.read.parquet(str(tmp_path / "x")).columns == list(BAR_COLUMNS)
    assert df.sparkSession.read.parquet(str(tmp_path / "x")).first()["symbol"] == "AAA"
    with pytest.raises(Exception, match="(?i)exists"):
        write_bars(df, str(tmp_path / "x"))
    write_bars(df, str(tmp_path / "x"), overwrite=True)
    with pytest.raises(PanelError):
        write_frame(df.where("false"), str(tmp_path / "y"))


def test_read_tables_and_specs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,timestamp\nA,2024-01-02\n")
    assert dict(source.read_table(spark, str(tmp_path / "a.csv")).dtypes)["timestamp"] == "date"
    with pytest.raises(PanelError):
        source.read_table(spark, "a.txt")
    (tmp_path / "s.yaml").write_text("features: [{name: x}]\n")
    assert source.read_spec(str(tmp_path / "s.yaml"), allow_list=True) == [{"name": "x"}]
    (tmp_path / "s.json").write_text("[1]")
    with pytest.raises(PanelError):
        source.read_spec(str(tmp_path / "s.json"))


def test_concat_features(spark, day):
    one = spark.createDataFrame([("A", day(0), "f", 1.0)], "symbol string, timestamp timestamp_ntz, feature_set_id string, sma_5d double")
    assert source.concat_features([one, one], ["sma_5d"]).count() == 2
    with pytest.raises(PanelError):
        source.concat_features([one, one.withColumnRenamed("sma_5d", "ema_5d")], ["sma_5d", "ema_5d"])
    with pytest.raises(PanelError):
        source.concat_features([one.where("false")], ["sma_5d"])


def page(token=None):
    bar = {"t": "2024-01-02T05:00:00Z", "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 10, "n": 3, "vw": 1.2}
    return {"bars": {"aaa": [bar], "bbb": [bar | {"t": "2024-01-03T05:00:00Z"}]}, "next_page_token": token}


def test_paging(spark):
    request = rest.BarsRequest(("aaa", "bbb"), "2024-01-01", "2024-01-05", feed="sip-historical")
    transport = rest.CannedTransport([page("next"), page()])
    got = rest.read_bars(spark, transport, "u", request)
    assert got.count() == 4 and {r["symbol"] for r in got.collect()} == {"AAA", "BBB"}
    assert transport.asked[0]["feed"] == "sip" and transport.asked[1]["page_token"] == "next"
    with pytest.raises(rest.RestError, match="beyond 1 pages"):
        rest.read_bars(spark, rest.CannedTransport([page("next")]), "u", request, max_pages=1)
    with pytest.raises(rest.RestError, match="REDACTED"):
        rest.read_bars(spark, rest.CannedTransport([{"m": "key hunter2"}], 403), "u", request, secrets=["hunter2"])
    with pytest.raises(rest.RestError, match="malformed"):
        rest.read_bars(spark, rest.CannedTransport([{"bars": []}]), "u", request)
    assert len(rest.redacted("x" * 900)) == 503
    for broken in (dict(symbols=()), dict(limit=0), dict(limit=10_001), dict(adjustment="x"), dict(feed="sip-realtime"), dict(timeframe="1Min"), dict(end="2023-01-01")):
        with pytest.raises(PanelError):
            rest.BarsRequest(**({"symbols": ("A",), "start": "2024-01-01", "end": "2024-01-02"} | broken))


def test_controlled_fetch_and_ledger(spark, tmp_path):
    ledger = Ledger(tmp_path / "ledger.jsonl")
    options = dict(symbols=["AAA", "BBB"], start="2024-01-01", end="2024-01-05")
    got = rest.controlled_fetch(spark, rest.CannedTransport([page()]), "u", str(tmp_path / "out"), ledger=ledger, **options)
    assert got.rows_written == 2 and all(got.checks.values()) and len(ledger.entries()) == 1
    with pytest.raises(PanelError, match="already"):
        rest.controlled_fetch(spark, rest.CannedTransport([page()]), "u", str(tmp_path / "out"), **options)
    for broken in (dict(symbols=list("ABCDEF")), dict(end="2024-03-01"), dict(max_pages=6)):
        with pytest.raises(PanelError):
            rest.controlled_fetch(spark, rest.CannedTransport([page()]), "u", str(tmp_path / "other"), **(options | broken))
    assert rest.dry_run(spark, str(tmp_path / "dry")).rows_written == 4


def test_saved_pages_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(page()))
    spark.dataSource.register(rest.PagedBarsSource)
    assert spark.read.format("paged_bars").option("path", str(tmp_path)).load().count() == 2


def test_http_transport(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ok = "page_token" not in self.path
            seen.append((self.path, self.headers["X-Key-Id"]))
            body = json.dumps({"bars": {"AAA": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5, "n": 1, "vw": 1.5}]}, "next_page_token": "more"} if ok else {"error": "key hidden rejected"}).encode()
            self.send_response(200 if ok else 403)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    import json

    seen: list = []
    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    access = rest.BarsAccess.from_env({"BARS_DATA_URL": f"http://127.0.0.1:{server.server_port}/bars", "BARS_KEY_ID": "kid", "BARS_KEY_SECRET": "hidden"})
    assert "hidden" not in repr(access) and "kid" not in repr(access)
    request = rest.BarsRequest(("aaa",), "2024-01-02", "2024-01-03")
    with pytest.raises(rest.RestError) as e:
        list(rest.pages(rest.HttpTransport(), access.url, request, headers=access.headers, secrets=access.secrets))
    server.shutdown()
    server.server_close()
    assert "403" in str(e.value) and "hidden" not in str(e.value) and len(seen) == 2 and seen[0][1] == "kid" and "symbols=AAA" in seen[0][0]
    with pytest.raises(rest.RestError) as e:
        rest.HttpTransport(timeout=2).get(access.url, headers=access.headers, params={})
    assert "ConnectionRefusedError" in str(e.value) and "hidden" not in str(e.value)
    with pytest.raises(PanelError):
        rest.BarsAccess.from_env({"BARS_KEY_ID": "kid"})


def test_gaps_follow_from_what_is_declared():
    best = dict(rest.BEST)
    assert rest.known_gaps(**best, data_feed="sip-historical") == []
    assert len(rest.known_gaps(**rest.STATUSES, data_feed="iex")) == 4
    with pytest.raises(PanelError):
        rest.controlled_fetch(None, None, "", "x", symbols=list("ABCDEF"), start="2024-01-01", end="2024-03-01")
