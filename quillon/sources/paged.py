"""A Spark data source of replies in pages: a task takes some instruments and follows each page's ``next_url``.

``spark.read.format("paged_replies")`` over a folder with a file per page, as a
market-data service's client leaves them: ``{"ticker", "status", "results": [...],
"next_url"}``. Where a page refers to the next one by name, the chain is
followed to its end. Options:

* ``path``: the folder. ``tickers``: comma-separated instruments to ask for;
  without it, all that have a first page ``<ticker>.json``.
* ``retries``: tries of a page that is throttled (status 429 or ``THROTTLED``)
  after the first; ``wait``: seconds before the first retry, doubled each time.
* ``most``: results per instrument; none by default.

A filter on ``ticker`` (equality or IN) is pushed down: only the asked
instruments' files are opened. Rows: (``ticker``, ``page``, ``item``, ``result``,
``fetch_status``, ``retries``). ``result`` is an element of ``results`` as JSON.
An instrument always has a row: one without result where there is nothing, its
status ``ok``, ``empty_result``, ``not_found``, ``throttled`` (still, after all
retries: pages up to there stay) or ``malformed``. A chain that comes back to
one of its pages ends as ``malformed``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillon.sources.files import opened

SCHEMA = "ticker string, page int, item int, result string, fetch_status string, retries int"


#: Tasks that even a few instruments are dealt to, and instruments that a task takes at most: a task for each would cost more than its pages.
LEAST_TASKS, MOST_IN_TASK = 64, 256


class Asked(InputPartition):
    def __init__(self, tickers: list[str]):
        super().__init__(tickers)
        self.tickers = tickers


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        named = options.get("tickers")
        self.asked = [x.strip() for x in named.split(",") if x.strip()] if named is not None else None
        self.retries, self.wait = int(options.get("retries", 2)), float(options.get("wait", 0.1))
        self.most = int(options["most"]) if "most" in options else None

    def folder(self) -> tuple[arrow_fs.FileSystem, str]:
        return opened(self.path)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ticker",):
                self.narrow({f.value})
            elif isinstance(f, In) and f.attribute == ("ticker",):
                self.narrow(set(f.value))
            else:
                yield f

    def narrow(self, wanted: set[str]) -> None:
        self.asked = sorted(wanted if self.asked is None else wanted & set(self.asked))

    def partitions(self) -> list[InputPartition]:
        """Instruments in runs of their order; the folder is only listed where no instrument is named."""
        if self.asked is None:
            where, root = self.folder()
            names = [f.base_name for f in where.get_file_info(arrow_fs.FileSelector(root)) if f.is_file]
            self.asked = sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and "@" not in n)
        size = max(1, min(MOST_IN_TASK, -(-len(self.asked) // LEAST_TASKS)))
        return [Asked(self.asked[k : k + size]) for k in range(0, len(self.asked), size)]

    def page(self, where: arrow_fs.FileSystem, path: str) -> tuple[str, dict, int]:
        """(status, reply, retries). A throttled page holds what each try gets, in ``attempts``, as a log of replies does."""
        info = where.get_file_info(path)
        if not info.is_file:
            return "not_found", {}, 0
        try:
            with where.open_input_stream(path) as f:
                replies = json.loads(f.read())
        except ValueError:
            return "malformed", {}, 0
        tries = replies if isinstance(replies, list) else [replies]
        for k in range(self.retries + 1):
            reply = tries[min(k, len(tries) - 1)] if tries else {}
            status = str(reply.get("status", "OK")).upper() if isinstance(reply, dict) else ""
            if status not in ("429", "THROTTLED"):
                known = {"404": "not_found", "NOT_FOUND": "not_found", "": "malformed"}
                return known.get(status, "ok"), reply if isinstance(reply, dict) else {}, k
            if k < self.retries:
                time.sleep(self.wait * 2**k)
        return "throttled", {}, self.retries

    def read(self, partition: Asked) -> Iterator[tuple]:
        where, root = self.folder()
        for ticker in partition.tickers:
            yield from self.chain(where, root, ticker)

    def chain(self, where: arrow_fs.FileSystem, root: str, ticker: str) -> Iterator[tuple]:
        """The rows of one instrument."""
        name, seen, page, item, retries, status = f"{ticker}.json", set(), 0, 0, 0, "ok"
        while name:
            if name in seen:
                status = "malformed"
                break
            seen.add(name)
            status, reply, more = self.page(where, f"{root.rstrip('/')}/{name}")
            retries += more
            results = reply.get("results") or []
            if not isinstance(results, list):
                results = [results]
            for r in results:
                if self.most is not None and item >= self.most:
                    return
                yield ticker, page, item, json.dumps(r, separators=(",", ":")), "ok", retries
                item += 1
            # The address of the next page: its last part names the file.
            following = reply.get("next_url") if status == "ok" else None
            name, page = (str(following).rsplit("/", 1)[-1] if following else ""), page + 1
        if status != "ok" or not item:
            yield ticker, page - 1, None, None, "empty_result" if status == "ok" else status, retries


def publish(replies: DataFrame, path: str) -> None:
    """Writes replies as pages: a file ``name`` with ``body`` for each row, by the tasks that hold them, into a shared folder."""

    def write(rows: Iterator[Row]) -> None:
        where, root = PagedReader({"path": path}).folder()
        where.create_dir(root, recursive=True)
        for r in rows:
            with where.open_output_stream(f"{root.rstrip('/')}/{r['name']}") as f:
                f.write(r["body"].encode())

    replies.select("name", "body").foreachPartition(write)


class PagedReplies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_replies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedReplies)
