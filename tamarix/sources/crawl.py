"""The crawl's edge: politeness, page descriptors, and landed pages.

Fetching is not a query; pages are landed as raw_listing (scope, page, snapshot,
html, attempt, error) and raw_detail (url, scope, title, status, hops, final_url,
html, error), and the operators start there. A 404 for robots.txt allows, as is
the convention.

A scope's listing is read in order, since each page tells whether to go on: page
1 (snapshot `first`) gives the official count and with it the last page to ask
for; reading stops when all links are seen or after pages in a row without a new
one (a page that fails is one); page 1 is read again at the end (`final`). A scan
that isn't complete is made once more. Scopes are read side by side, detail pages
by `slots` tasks.

A worker keeps its connection to a host from page to page. All tasks of a stage
share a rate: time is divided into slots of 1 / rate seconds, which are dealt to
the tasks in turn, so that no two tasks ask in the same slot and nothing has to
be said between them (their clocks must agree as far as the slots are long).

With a folder for pages (`landing`, in any file system that Arrow opens) each page
that was read is put there at once, under what asked for it; a task that is run
again after a failure, or a crawl with the same folder, asks only for what isn't
there.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import math
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime
from urllib import error, parse, request, robotparser

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed_values as V
from ..shipping import ship
from . import html as H

RAW_LISTING = "scope string, page int, snapshot string, html string"
LISTING_PAGES = f"{RAW_LISTING}, attempt int, error string"
RAW_DETAIL = "url string, scope string, title string, status int, hops array<struct<status:int,url:string>>, final_url string, html string"
DETAIL_PAGES = f"{RAW_DETAIL}, error string"
AGAIN = (429, 500, 502, 503, 504)


def robots_allow(robots_text: str | None, base_url: str, agent: str = "*", status: int = 200) -> tuple[bool, str]:
    if status == 404:
        return True, "no robots.txt: allowed by convention"
    try:
        rules = robotparser.RobotFileParser()
        rules.parse((robots_text or "").splitlines())
        return all(rules.can_fetch(agent, base_url + p) for p in V.ROBOTS_PATHS), "robots.txt parsed"
    except Exception as e:  # a policy that can't be read denies
        return False, f"robots check failed: {e}"


def listing_params(scope: str, page: int) -> dict[str, str | int]:
    return V.LISTING_PARAMS | {"stat": scope, "page": page}


def target_pages(official: int) -> int:
    """The last page to ask for; a count that can't be is refused."""
    if not 0 <= official <= V.MOST_OFFICIAL:
        raise ValueError(f"an official count of {official}")
    return max(1, -(-official // V.PAGE_SIZE) + V.GUARD_PAGES)


@dataclass
class Fetched:
    status: int
    final_url: str
    text: str
    hops: list[tuple[int, str]]


class Session:
    """Connections to hosts that are kept from one page to the next."""

    def __init__(self, agent: str):
        self.headers = V.HEADERS | {"User-Agent": agent}
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def _connection(self, url: parse.SplitResult, timeout: float) -> tuple[http.client.HTTPConnection, str]:
        """A connection for a url, and what to ask it for."""
        what = parse.urlunsplit(("", "", url.path or "/", url.query, ""))
        proxy = None if request.proxy_bypass(url.hostname or "") else request.getproxies().get(url.scheme)
        if (url.scheme, url.netloc) not in self.open:
            kind = http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection
            at = parse.urlsplit(proxy).netloc if proxy else url.netloc
            connection = kind(at, timeout=timeout)
            if proxy and url.scheme == "https":
                connection.set_tunnel(url.netloc)
            self.open[url.scheme, url.netloc] = connection
        connection = self.open[url.scheme, url.netloc]
        connection.timeout = timeout
        if connection.sock:
            connection.sock.settimeout(timeout)
        return connection, parse.urlunsplit(url._replace(fragment="")) if proxy and url.scheme == "http" else what

    def _once(self, url: str, timeout: float) -> tuple[http.client.HTTPResponse, bytes]:
        at = parse.urlsplit(url)
        if at.scheme not in ("http", "https") or not at.hostname:
            raise ValueError(f"no address of a page: {url}")
        for first in (True, False):
            connection, what = self._connection(at, timeout)
            kept = connection.sock is not None
            try:
                connection.request("GET", what, headers=self.headers)
                answer = connection.getresponse()
                return answer, answer.read()
            except (OSError, http.client.HTTPException) as e:
                connection.close()
                del self.open[at.scheme, at.netloc]
                # a kept connection that the host has closed meanwhile says nothing
                if not (first and kept and isinstance(e, (http.client.BadStatusLine, ConnectionError))):
                    raise e if isinstance(e, TimeoutError) else error.URLError(e) from e
        raise AssertionError

    def get(self, url: str, timeout: float) -> Fetched:
        hops: list[tuple[int, str]] = []
        now = parse.urlunsplit(parse.urlsplit(url)._replace(fragment=""))
        while True:
            answer, body = self._once(now, timeout)
            to = answer.headers.get("Location")
            if answer.status in (301, 302, 303, 307, 308) and to:
                hops.append((answer.status, now))
                if len(hops) > 10:
                    raise error.HTTPError(now, answer.status, "redirected too often", answer.headers, None)
                now = parse.urljoin(now, to)
            elif answer.status >= 400:
                raise error.HTTPError(now, answer.status, answer.reason, answer.headers, None)
            else:
                return Fetched(answer.status, now, body.decode(answer.headers.get_content_charset() or "utf-8", "replace"), hops)


_LOCAL = threading.local()


def session(agent: str) -> Session:
    """This worker's session."""
    kept = _LOCAL.__dict__.setdefault("sessions", {})
    return kept.setdefault(agent, Session(agent))


class Slots:
    """Task `index` of `tasks` that share `rate` requests a second (0: any)."""

    def __init__(self, rate: float = 0.0, tasks: int = 1, index: int = 0):
        self.rate, self.tasks, self.index, self.last = rate, tasks, index, -1

    def next(self, now: float) -> float:
        """The time of the task's next slot, which is taken then."""
        round_ = max(self.last + 1, math.ceil((now * self.rate - self.index) / self.tasks))
        self.last = round_
        return (round_ * self.tasks + self.index) / self.rate

    def wait(self) -> None:
        if self.rate > 0:
            now = time.time()
            time.sleep(max(0.0, self.next(now) - now))


class Landing:
    """Pages by what asked for them, in a folder."""

    def __init__(self, uri: str):
        local = re.sub("^file:/*", "/", uri)
        self.system, self.root = pafs.FileSystem.from_uri(f"file://{local}" if local.startswith("/") else uri)

    def _at(self, key: str) -> str:
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}.json"

    def get(self, key: str) -> Fetched | None:
        at = self._at(key)
        if self.system.get_file_info(at).type != pafs.FileType.File:
            return None
        with self.system.open_input_stream(at) as f:
            page = json.loads(f.read())
        return Fetched(page["status"], page["final_url"], page["text"], [tuple(h) for h in page["hops"]])

    def put(self, key: str, page: Fetched) -> None:
        at = self._at(key)
        self.system.create_dir(at.rpartition("/")[0])
        aside = f"{at}.{hashlib.sha256(f'{time.time_ns()}{threading.get_ident()}'.encode()).hexdigest()[:16]}"
        with self.system.open_output_stream(aside) as f:
            f.write(json.dumps(page.__dict__).encode())
        self.system.move(aside, at)

    def read(self, key: str, ask: Callable[[], Fetched]) -> Fetched:
        page = self.get(key)
        if page is None:
            page = ask()
            self.put(key, page)
        return page


def waiting(header: str | None, attempt: int, backoff: float) -> float:
    """Seconds to wait before the next attempt: what the server says (seconds or
    a date), else twice as long each time."""
    if header:
        try:
            return max(0.0, float(header))
        except ValueError:
            pass
        try:
            return max(0.0, parsedate_to_datetime(header).timestamp() - time.time())
        except ValueError:
            pass
    return backoff * 2**attempt


def fetch(url: str, agent: str = "tamarix", timeout: float = 30, retries: int = 5, backoff: float = 0.8, pause: float = 0.05, slots: Slots | None = None) -> Fetched:
    """A page, with its redirects; errors of the network and answers that ask for
    it are tried again. Each try waits for a slot, if there are any, else for a
    while of 1 to 3.6 times `pause`."""
    import random

    for attempt in range(retries + 1):
        if slots is not None and slots.rate > 0:
            slots.wait()
        else:
            time.sleep(random.uniform(pause, 3.6 * pause))
        try:
            return session(agent).get(url, timeout)
        except error.HTTPError as e:
            if e.code not in AGAIN or attempt == retries:
                raise
            header = e.headers.get("Retry-After")
        except OSError:
            if attempt == retries:
                raise
            header = None
        time.sleep(waiting(header, attempt, backoff))
    raise AssertionError


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def scan(read: Callable[[int], str], attempt: int) -> Iterator[tuple]:
    """(page, snapshot, html, attempt, error) of one scan of a listing; its last
    row has the error "incomplete" and no page, if it isn't complete."""
    html = read(1)
    yield 1, "first", html, attempt, None
    official, links = H.listing_facts(html)
    last, seen, stagnant, failed, page = target_pages(official), set(links), 0, False, 2
    while len(seen) < official and page <= last and stagnant < V.STAGNANT_PAGES:
        before = len(seen)
        try:
            html = read(page)
            yield page, "body", html, attempt, None
            seen.update(H.listing_links(html))
        except (OSError, ValueError) as e:
            failed = True
            yield page, "body", None, attempt, told(e)
        stagnant = stagnant + 1 if len(seen) == before else 0
        page += 1
    html = read(1)
    yield 1, "final", html, attempt, None
    after, links = H.listing_facts(html)
    seen.update(links)
    return official == after == len(seen) and not failed


class _Scope(InputPartition):
    def __init__(self, scope: str, slot: int = 0, slots: int = 1):
        self.scope, self.slot, self.slots = scope, slot, slots


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        scopes = self.options.get("scopes", ",".join(V.SCOPES)).split(",")
        return [_Scope(s, i, len(scopes)) for i, s in enumerate(scopes)]

    def read(self, part: _Scope) -> Iterator[tuple]:
        how = {k: float(self.options[k]) for k in ("backoff", "pause", "timeout") if k in self.options}
        how["slots"] = Slots(float(self.options.get("rate", "0")), part.slots, part.slot)
        landing = Landing(self.options["landing"]) if "landing" in self.options else None

        def rows(attempt: int):
            firsts = iter(("first", "final"))  # page 1 is read twice

            def page(n: int) -> str:
                ask = lambda: fetch(f"{self.options['base_url']}{V.LIST_PATH}?{parse.urlencode(listing_params(part.scope, n))}", **how)
                which = next(firsts) if n == 1 else "body"
                return (landing.read(f"listing {part.scope} {attempt} {n} {which}", ask) if landing else ask()).text

            found = scan(page, attempt)
            while True:
                try:
                    yield part.scope, *next(found)
                except StopIteration as end:
                    return end.value

        if not (yield from rows(1)):
            time.sleep(float(self.options.get("rest", "1")))
            yield from rows(2)


class ListingSource(DataSource):
    """spark.read.format("listing_pages") with options base_url and, if need be,
    scopes, pause, backoff, timeout, rest, rate (requests a second of all scopes
    together), landing: a partition a scope."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return LISTING_PAGES

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


_DETAIL_ARROW = pa.schema(
    [
        ("url", pa.string()), ("scope", pa.string()), ("title", pa.string()), ("status", pa.int32()), ("hops", pa.list_(pa.struct([("status", pa.int32()), ("url", pa.string())]))),
        ("final_url", pa.string()), ("html", pa.string()), ("error", pa.string()),
    ]
)


def detail_pages(tasks: DataFrame, rest: float = 0.0, slots: int | None = None, rate: float = 0.0, landing: str | None = None, **how) -> DataFrame:
    """tasks (url, scope, title) as raw_detail pages; what can't be read has an
    error. `slots` tasks (else as many as there are partitions) share `rate`
    requests a second. Land the result before it is used twice."""
    ship(tasks.sparkSession)
    if slots is None and rate > 0:
        raise ValueError("a rate is dealt to a number of slots")
    wanted = tasks.select("url", "scope", "title")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Slots(rate, slots or 1, TaskContext.get().partitionId() % (slots or 1))
        pages = Landing(landing) if landing else None
        for b in batches:
            for task in b.to_pylist():
                time.sleep(rest)
                row = dict.fromkeys(_DETAIL_ARROW.names) | task
                ask = lambda url=task["url"]: fetch(url, slots=own, **how)
                try:
                    got = pages.read(f"detail {task['url']}", ask) if pages else ask()
                    row |= {"status": got.status, "hops": [{"status": s, "url": u} for s, u in got.hops], "final_url": got.final_url, "html": got.text}
                except (OSError, ValueError) as e:
                    row |= {"hops": [], "error": told(e)}
                yield pa.RecordBatch.from_pylist([row], schema=_DETAIL_ARROW)

    return (wanted.repartition(slots, "url") if slots else wanted).mapInArrow(fetched, DETAIL_PAGES)
