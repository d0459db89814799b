"""A paged bars endpoint as a source: validated requests, an injected transport, and a bounded fetch.

The transport is any object with ``get(url, headers=..., params=...)`` that returns an object with
``status_code``, ``headers``, ``json()`` and ``text()``. ``HttpTransport`` is one over the standard library; only it
opens connections, and only when it is given.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import socket
import ssl
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import BAR_COLUMNS, BARS, SYMBOL, PanelError
from .bars import as_date, scan, tickers
from .sinks import write_bars

# The payload's schema, accepted options and limits.
PAYLOAD = "bars map<string,array<struct<t:timestamp,o:double,h:double,l:double,c:double,v:bigint,n:bigint,vw:double>>>, next_page_token string"
ADJUSTMENTS = ("raw", "split", "dividend", "all")
FEEDS = {"iex": "iex", "sip-historical": "sip"}
BODY_LIMIT = 500
MAX_SYMBOLS, MAX_DAYS, MAX_PAGES = 5, 31, 5
# What is declared of a fetch, the best of each status, and feeds that cover a part of the market.
TIERS = {"iex": 0, "sip-historical": 1}
STATUSES = {"survivorship_bias_status": "partial", "corporate_actions_status": "partial", "pit_status": "best_effort"}
BEST = {"survivorship_bias_status": "controlled", "corporate_actions_status": "clean", "pit_status": "guaranteed"}
PARTIAL_FEEDS = {"iex": "the volume of one venue"}


class RestError(RuntimeError):
    """A request or response cannot be handled safely; the message never holds a secret."""


@dataclass(frozen=True)
class BarsRequest:
    symbols: tuple[str, ...]
    start: dt.date
    end: dt.date
    timeframe: str = "1Day"
    limit: int = 1000
    adjustment: str = "raw"
    feed: str = "iex"

    def __post_init__(self) -> None:
        object.__setattr__(self, "symbols", tuple(tickers(self.symbols)))
        object.__setattr__(self, "start", as_date(self.start, "start"))
        object.__setattr__(self, "end", as_date(self.end, "end"))
        if self.end < self.start:
            raise PanelError("end lies before start")
        if self.timeframe != "1Day":
            raise PanelError("only daily bars are served")
        if isinstance(self.limit, bool) or not 1 <= self.limit <= 10_000:
            raise PanelError("limit must lie between 1 and 10000")
        if self.adjustment not in ADJUSTMENTS:
            raise PanelError(f"adjustment must be one of {ADJUSTMENTS}")
        if self.feed not in FEEDS:
            raise PanelError(f"feed must be one of {tuple(FEEDS)}")

    def params(self, page_token: str | None = None) -> dict:
        found = {"symbols": ",".join(self.symbols), "timeframe": self.timeframe, "start": self.start.isoformat(), "end": self.end.isoformat(), "limit": self.limit, "adjustment": self.adjustment, "feed": FEEDS[self.feed]}
        return found | ({"page_token": page_token} if page_token else {})


def redacted(body: str, secrets: Sequence[str] = ()) -> str:
    """One line, secrets masked, bounded."""
    body = " ".join(body.split())
    for s in secrets:
        if s:
            body = body.replace(s, "[REDACTED]")
    return body if len(body) <= BODY_LIMIT else body[:BODY_LIMIT] + "..."


def pages(transport, url: str, request: BarsRequest, *, headers: dict | None = None, secrets: Sequence[str] = (), max_pages: int = 100) -> Iterator[str]:
    """JSON text of each page; fails rather than stop short when pages go on beyond ``max_pages``."""
    if max_pages < 1:
        raise PanelError("max_pages must be at least 1")
    token = None
    for _ in range(max_pages):
        response = transport.get(url, headers=headers or {}, params=request.params(token))
        if response.status_code != 200:
            raise RestError(f"bars request failed with status {response.status_code}: {redacted(response.text(), secrets)}")
        try:
            payload = response.json()
        except Exception as e:
            raise RestError("bars response is not JSON") from e
        if not isinstance(payload, dict) or not isinstance(payload.get("bars"), dict) or not isinstance(payload.get("next_page_token"), str | None):
            raise RestError("bars response is malformed")
        yield json.dumps(payload)
        token = payload.get("next_page_token")
        if not token:
            return
    raise RestError(f"bars go on beyond {max_pages} pages")


def flatten(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bars from JSON pages: a map of symbols, each with its array of bars."""
    parsed = raw.select(F.from_json(column, PAYLOAD).alias("p"))
    rows = parsed.select(F.explode("p.bars").alias(SYMBOL, "list")).select(F.upper(SYMBOL).alias(SYMBOL), F.explode("list").alias("b"))
    names = dict(timestamp="t", open="o", high="h", low="l", close="c", volume="v", trade_count="n", vwap="vw")
    return rows.select(SYMBOL, *(F.col(f"b.{short}").alias(name) for name, short in names.items()))


def read_bars(spark: SparkSession, transport, url: str, request: BarsRequest, **options) -> DataFrame:
    """All pages as a DataFrame; malformed bars (a null in any field) are an error."""
    text = [(page,) for page in pages(transport, url, request, **options)]
    bars = flatten(spark.createDataFrame(text, "value string"))
    broken = bars.where(" or ".join(f"{c} is null" for c in BAR_COLUMNS))
    if not broken.isEmpty():
        raise RestError("bars response is malformed")
    return bars


class PagedBarsSource(DataSource):
    """``spark.read.format("paged_bars")`` over saved JSON pages: option ``path`` is a folder or file, one partition per page."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self):
        return BARS

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path = Path(options["path"])

    def partitions(self):
        files = sorted(self.path.glob("*.json")) if self.path.is_dir() else [self.path]
        return [InputPartition(str(f)) for f in files]

    def read(self, partition):
        payload = json.loads(Path(partition.value).read_text(encoding="utf-8"))
        for symbol, rows in payload["bars"].items():
            for r in rows:
                yield symbol.upper(), dt.datetime.fromisoformat(r["t"]), float(r["o"]), float(r["h"]), float(r["l"]), float(r["c"]), int(r["v"]), int(r["n"]), float(r["vw"])


@dataclass(frozen=True)
class FetchResult:
    path: str
    declaration_path: str
    rows_written: int
    symbols: list[str]
    checks: dict


def verify(spark: SparkSession, path: str, requested: Sequence[str]) -> tuple[int, list[str], dict]:
    """Reads back what was written, in one aggregate; fails unless there are rows and all are of requested symbols."""
    own = F.col(SYMBOL).isin(list(requested))
    stray = F.collect_set(F.when(~own, F.col(SYMBOL)))
    got = scan(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("own"), F.array_sort(F.collect_set(F.when(own, F.col(SYMBOL)))).alias("found"), F.size(stray).alias("stray")).first()  # symbols bounded by the request
    checks = {"rows": got["n"] > 0, "symbols": got["stray"] == 0, "counts": got["own"] == got["n"]}
    if not all(checks.values()):
        raise RestError(f"verification failed: {[k for k, ok in checks.items() if not ok]}")
    return got["n"], got["found"], checks


def known_gaps(**declared: str) -> list[str]:
    """What a declaration leaves open: each status short of the best one, and what the feed does not cover."""
    open_ends = [f"{field} is {declared[field]}, not {best}" for field, best in BEST.items() if declared[field] != best]
    return open_ends + ([f"data_feed {declared['data_feed']} covers {PARTIAL_FEEDS[declared['data_feed']]}"] if declared["data_feed"] in PARTIAL_FEEDS else [])


def _bounded(request: BarsRequest, max_pages: int) -> None:
    """What a controlled fetch may ask for."""
    asked = {"symbols": (len(request.symbols), MAX_SYMBOLS), "calendar days": ((request.end - request.start).days + 1, MAX_DAYS), "pages": (max_pages, MAX_PAGES)}
    over = [f"{n} {what}, of at most {most}" for what, (n, most) in asked.items() if not 1 <= n <= most]
    if over:
        raise PanelError("; ".join(over))


def controlled_fetch(spark: SparkSession, transport, url: str, out_dir: str, *, symbols: Sequence[str], start, end, feed: str = "iex", max_pages: int = MAX_PAGES, ledger=None, secrets: Sequence[str] = (), headers: dict | None = None, **options) -> FetchResult:
    """A tightly bounded fetch: outputs must be new; what is written is read back, verified, declared and recorded."""
    from ..plans.contracts import DataDeclaration

    request = BarsRequest(tuple(symbols), start, end, feed=feed, **options)
    _bounded(request, max_pages)
    target, note = f"{out_dir}/historical_bars.parquet", Path(out_dir) / "data_declaration.yaml"
    if Path(target).exists() or note.exists():
        raise PanelError(f"{out_dir} already holds a fetch")
    bars = read_bars(spark, transport, url, request, secrets=secrets, max_pages=max_pages, headers=headers)
    if bars.isEmpty():
        raise RestError("the fetch returned no bars")
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    write_bars(bars, target)
    n, found, checks = verify(spark, target, request.symbols)
    tier, statuses = TIERS[feed], STATUSES | {"data_feed": feed}
    names = f"dq-tier{tier}-{feed}-{request.start}-{request.end}", "-".join(request.symbols).lower()
    declared = DataDeclaration(names[0], tier, "requested-symbols", names[1], **statuses, date_range=(request.start, request.end), known_gaps=tuple(known_gaps(**statuses)))
    note.write_text(declared.to_yaml(), encoding="utf-8")
    if ledger is not None:
        entry = {"record_type": "fetch", "status": "success", "verification_passed": True, "rows_written": n, "symbols": found, "path": target, "feed": feed, "start": str(request.start), "end": str(request.end)}
        ledger.append(entry | {"data_declaration_id": declared.data_declaration_id, "known_gaps": list(declared.known_gaps)}, id_field="run_id", secrets=secrets)
    return FetchResult(target, str(note), n, found, checks)


@dataclass(frozen=True)
class BarsAccess:
    """Where bars are served and the credentials to ask for them, which no text form of it shows."""

    url: str
    key_id: str = field(repr=False)
    secret: str = field(repr=False)

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None) -> BarsAccess:
        """From BARS_DATA_URL, BARS_KEY_ID and BARS_KEY_SECRET; each is needed."""
        env = os.environ if environ is None else environ
        found = {name: env.get(name, "").strip() for name in ("BARS_DATA_URL", "BARS_KEY_ID", "BARS_KEY_SECRET")}
        missing = [name for name, value in found.items() if not value]
        if missing:
            raise PanelError(f"the environment lacks {missing}")
        return cls(*found.values())

    @property
    def headers(self) -> dict[str, str]:
        return {"X-Key-Id": self.key_id, "X-Key-Secret": self.secret, "Accept": "application/json"}

    @property
    def secrets(self) -> tuple[str, str]:
        return self.key_id, self.secret


class _HttpResponse:
    def __init__(self, status_code: int, body: bytes, headers):
        self.status_code, self.body, self.headers = status_code, body, dict(headers or {})

    def json(self):
        return json.loads(self.body)

    def text(self) -> str:
        return self.body.decode("utf-8", "replace")


class HttpTransport:
    """GET over the standard library. A status is a response; no response at all is a RestError that says why."""

    def __init__(self, timeout: float = 30.0):
        self.timeout = timeout

    def get(self, url: str, *, headers: dict, params: dict):
        asked = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers=headers, method="GET")
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as response:
                return _HttpResponse(response.status, response.read(), response.headers)
        except urllib.error.HTTPError as e:
            return _HttpResponse(e.code, e.read(), e.headers)
        except OSError as e:  # of which URLError and TimeoutError are kinds
            raise RestError(f"no response from the bars endpoint: {self.diagnosis(e)}") from e

    @staticmethod
    def diagnosis(error: BaseException) -> str:
        """The kind of the underlying fault and what to look at, without any text of the request."""
        cause = getattr(error, "reason", error)
        cause = cause if isinstance(cause, BaseException) else error
        hints = ((TimeoutError, "it took too long"), (socket.gaierror, "the host's name has no address"), (ssl.SSLError, "the certificate was not accepted"), (ConnectionError, "the connection was refused or broken off"))
        hint = next((text for kind, text in hints if isinstance(cause, kind)), "the network cannot be reached")
        return f"{type(cause).__name__}, {hint}"


class _CannedResponse:
    def __init__(self, payload: dict, status_code: int = 200):
        self.payload, self.status_code, self.headers = payload, status_code, {}

    def json(self):
        return self.payload

    def text(self) -> str:
        return json.dumps(self.payload)


class CannedTransport:
    """Serves given payloads in order and remembers what was asked."""

    def __init__(self, payloads: Sequence[dict], status_code: int = 200):
        self.left, self.asked, self.status_code = list(payloads), [], status_code

    def get(self, url: str, *, headers: dict, params: dict):
        self.asked.append(params)
        return _CannedResponse(self.left.pop(0), self.status_code)


def dry_run(spark: SparkSession, out_dir: str) -> FetchResult:
    """Four fixed bars through the whole path: request, page, sink, verification."""
    bar = lambda day, p: {"t": f"2024-01-0{day}T05:00:00Z", "o": p, "h": p + 1, "l": p - 1, "c": p + 0.5, "v": 1000, "n": 10, "vw": p}
    payload = {"bars": {"AAA": [bar(2, 10.0), bar(3, 11.0)], "BBB": [bar(2, 20.0), bar(3, 21.0)]}, "next_page_token": None}
    return controlled_fetch(spark, CannedTransport([payload]), "mock:", out_dir, symbols=["AAA", "BBB"], start="2024-01-02", end="2024-01-03")
