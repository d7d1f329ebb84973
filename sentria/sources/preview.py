"""Channel preview pages: parsing, paging, and a Spark data source over them.

A page is parsed with the standard library into flat messages; what is
relational (deduplication, order, windows, cursors) is done on DataFrames. The
data source pages through channels, each a partition, with a transport that the caller injects, so
tests need no network. With the option ``pushdown``, bounds on ``post_id`` bound the pages that
are fetched; Spark asks that ``spark.sql.python.filterPushdown.enabled`` is set for it. A stream follows any number of
channels; its offset is the newest post of each, and its posts are read by the executors.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from html.parser import HTMLParser
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.runs import map_rows
from ..schemas import EVIDENCE

FAMILY, COLLECTOR = "telegram.channel", "preview"
#: Class names of the page (fixed values).
HISTORY, MESSAGE, SERVICE = "tgme_channel_history", "tgme_widget_message", "service_message"
BODY, FORWARDED, META, MORE = "js-message_text", "tgme_widget_message_forwarded_from_name", "tgme_widget_message_meta", "tme_messages_more"
UNSUPPORTED = "message_media_not_supported"
MEDIA = {
    "tgme_widget_message_photo_wrap": "photo", "tgme_widget_message_video_player": "video", "tgme_widget_message_roundvideo_player": "video", "tgme_widget_message_voice_player": "audio",
    "tgme_widget_message_document_wrap": "document", "tgme_widget_message_sticker_wrap": "other", "tgme_widget_message_poll": "other", "tgme_widget_message_location_wrap": "other",
}
VIDEO_THUMB = {"tgme_widget_message_video_thumb", "tgme_widget_message_roundvideo_thumb"}
MAX_BYTES = 4 << 20
MAX_ATTEMPTS, BACKOFF_S, POLL_PAGES = 5, 15, 10
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BACKGROUND = re.compile(r"background-image:[^;]*?url\(\s*['\"]?(https://[^)'\"]*)")


class SourceError(Exception):
    """A typed failure: not_found, rate_limited, unavailable, malformed, disabled or too_large."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def channel_name(raw: Column | str) -> Column:
    """A channel's canonical name, from a link or a handle; null if it is none."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    name = F.lower(F.regexp_replace(F.regexp_replace(F.trim(raw), "^(https://t\\.me/s/|https://t\\.me/|@)", ""), "/+$", ""))
    return F.when(name.rlike("^[a-z][a-z0-9_]{4,31}$"), name)


def background_image_url(style: Column | str) -> Column:
    style = F.col(style) if isinstance(style, str) else style
    return F.nullif(F.regexp_extract(style, r"background-image:[^;]*?url\(\s*['\"]?(https://[^)'\"]*)", 1), F.lit(""))


def plain_text(html: Column | str) -> Column:
    """Flat markup as text: breaks as line ends, tags dropped, lines trimmed at their ends, all trimmed."""
    html = F.col(html) if isinstance(html, str) else html
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def preview_url(channel: str, before: int | None = None, after: int | None = None, base: str = "https://t.me/s/") -> str:
    if urlparse(base).scheme != "https":
        raise ValueError("the base must be https")
    return f"{base}{channel}" + (f"?before={before}" if before is not None else f"?after={after}" if after is not None else "")


def _classes(attrs: dict) -> set[str]:
    return set((attrs.get("class") or "").split())


@dataclass
class _Message:
    post: str
    service: bool = False
    stamp: str | None = None
    meta: list[str] | None = None
    body: list[str] | None = None
    forwarded: list[str] | None = None
    media: list[dict] = field(default_factory=list)
    unsupported: bool = False


class _Element:
    __slots__ = ("tag", "at", "ends", "open")

    def __init__(self, tag: str, at: int):
        self.tag, self.at, self.open = tag, at, True
        #: what ends with the element: (list, item) to take out
        self.ends: list[tuple[list, object]] = []


class _Elements:
    """The open elements, by the rules by which browsers repair markup.

    A start tag ends an open paragraph, item or link where it can't be in it. An
    end tag of a block ends all that is open in it; one of a text style ends the style alone where blocks
    have begun since; any other end tag only counts within its block. End tags that nothing opened count for nothing.
    """

    BLOCKS = frozenset(
        "address article aside blockquote body center details dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
    )
    STYLES = frozenset("a b big code em font i nobr s small strike strong tt u".split())
    #: Start tags that don't end an open paragraph.
    IN_P = frozenset("body html li dd dt tbody td tfoot th thead tr".split())
    #: What an item ends, and the blocks beyond which it doesn't look.
    ITEMS = {"li": ({"li"}, {"ul", "ol", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.of: dict[str, list[_Element]] = {}
        self.blocks: list[_Element] = []

    def start(self, tag: str) -> _Element:
        if tag in self.BLOCKS and tag not in self.IN_P and self.of.get("p") and self._last("p") > max(map(self._last, ("table", "td", "th")), default=-1):
            self._pop_to(self.of["p"][-1])
        if tag in self.ITEMS:
            own, within = self.ITEMS[tag]
            found = max(own, key=self._last)
            if self._last(found) > max(map(self._last, within)):
                self._pop_to(self.of[found][-1])
        if tag == "a" and self.of.get("a"):
            self.end("a")
        element = _Element(tag, len(self.stack))
        self.stack.append(element)
        self.of.setdefault(tag, []).append(element)
        if tag in self.BLOCKS:
            self.blocks.append(element)
        return element

    def end(self, tag: str) -> None:
        if not self.of.get(tag):
            return
        element = self.of[tag][-1]
        if tag in self.BLOCKS or not self.blocks or element.at > self.blocks[-1].at:
            self._pop_to(element)
        elif tag in self.STYLES:
            self._close(element)

    def _last(self, tag: str) -> int:
        return self.of[tag][-1].at if self.of.get(tag) else -1

    def _pop_to(self, element: _Element) -> None:
        while len(self.stack) > element.at:
            top = self.stack.pop()
            if top.open:
                self._close(top)

    def _close(self, element: _Element) -> None:
        """Styles may end below what is still open; they stay in the stack until that ends."""
        element.open = False
        self.of[element.tag].pop()
        if element.tag in self.BLOCKS:
            self.blocks.pop()
        for held, item in element.ends:
            at = next(i for i in range(len(held) - 1, -1, -1) if held[i] is item)
            del held[at]


class _Parser(HTMLParser):
    """Gathers what the open messages say; a message that isn't closed holds those that follow."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = _Elements()
        self.history, self.more = False, []
        self.messages: list[_Message] = []
        self.now: list[_Message] = []
        self.regions: list[list[str]] = []
        self.wraps: list[dict] = []

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)

    def handle_starttag(self, tag: str, attributes: list) -> None:
        attrs = dict(attributes)
        names = _classes(attrs)
        # void elements end at once
        element = self.elements.start(tag) if tag not in _VOID else _Element(tag, -1)
        self.history |= HISTORY in names
        if MORE in names and (attrs.get("data-before") or "").isdigit():
            self.more.append(int(attrs["data-before"]))
        if tag == "br":
            for into in self.regions:
                into.append("\n")
        if MESSAGE in names and attrs.get("data-post"):
            self.messages.append(_Message(attrs["data-post"], SERVICE in names))
            self._hold(element, self.now, self.messages[-1])
        kind = next((k for n, k in MEDIA.items() if n in names), None)
        found = _BACKGROUND.search(attrs.get("style") or "")
        for item in self.wraps:
            if tag in ("video", "audio") and (attrs.get("src") or "").startswith("https://"):
                item["src"] = item["src"] or attrs["src"]
            if found and names & VIDEO_THUMB:
                item["thumb"] = item["thumb"] or found[1]
        for m in self.now:
            if tag == "time" and attrs.get("datetime"):
                m.stamp = m.stamp or attrs["datetime"]
            m.unsupported |= UNSUPPORTED in names
            for name, part in ((BODY, "body"), (FORWARDED, "forwarded"), (META, "meta")):
                if name in names and getattr(m, part) is None and tag not in _VOID:
                    setattr(m, part, [])
                    self._hold(element, self.regions, getattr(m, part))
            if kind:
                item = {"kind": kind, "url": found[1] if found else None, "src": None, "thumb": None}
                m.media.append(item)
                self._hold(element, self.wraps, item)

    def _hold(self, element: _Element, held: list, item: object) -> None:
        if element.at >= 0:
            held.append(item)
            element.ends.append((held, item))

    def handle_endtag(self, tag: str) -> None:
        self.elements.end(tag)

    def handle_data(self, data: str) -> None:
        for into in self.regions:
            into.append(data)


def _tidy(parts: list[str] | None) -> str | None:
    if parts is None:
        return None
    return "\n".join(line.rstrip() for line in "".join(parts).split("\n")).strip() or None


def evidence_of(channel: str, m: _Message) -> dict:
    """A message as evidence; raises ``SourceError('malformed')``."""
    owner, _, number = m.post.partition("/")
    if owner.lower() != channel or not number.isdigit():
        raise SourceError("malformed", "the post belongs to another channel")
    try:
        stamp = datetime.fromisoformat((m.stamp or "").replace("Z", "+00:00"))
    except ValueError as e:
        raise SourceError("malformed", "no time") from e
    if stamp.tzinfo is None:
        raise SourceError("malformed", "time without offset")
    media = [{"kind": x["kind"], "url": x["url"] or x["src"] or x["thumb"]} for x in m.media] or ([{"kind": "other", "url": None}] if m.unsupported else [])
    return {
        "source_id": f"{FAMILY}:{channel}", "external_id": f"{channel}/{number}", "published_at": stamp.astimezone(timezone.utc), "edited": "edited" in "".join(m.meta or []), "text": _tidy(m.body),
        "media": media, "forwarded_from": " ".join("".join(m.forwarded).split()) or None if m.forwarded is not None else None, "provenance": {"url": f"https://t.me/{channel}/{number}", "collector": COLLECTOR},
    }


@dataclass(frozen=True)
class ParsedPage:
    evidence: list[dict]  # oldest first, each post once
    ids: list[int]
    older: int | None


def parse_preview(channel: str, html: str) -> ParsedPage:
    parser = _Parser()
    parser.feed(html)
    parser.close()
    if not parser.history:
        raise SourceError("not_found", "no message history")
    rows = {int(m.post.partition("/")[2] or 0): evidence_of(channel, m) for m in parser.messages if not m.service}
    return ParsedPage([rows[i] for i in sorted(rows)], sorted(rows), min(parser.more, default=None))


PARSED = f"{EVIDENCE}, post_id long, older long, code string"


def parse_pages(pages: DataFrame) -> DataFrame:
    """Evidence rows of pages (``channel, html``) with ``post_id`` and the page's ``older`` cursor; a page that fails is one row with its ``code``."""

    def one(row: dict) -> Iterator[dict]:
        try:
            page = parse_preview(row["channel"], row["html"] or "")
        except SourceError as e:
            yield {"source_id": f"{FAMILY}:{row['channel']}", "code": e.code}
            return
        for number, evidence in zip(page.ids, page.evidence, strict=True):
            yield evidence | {"post_id": number, "older": page.older}

    return map_rows(pages.select("channel", "html"), one, PARSED)


def deduplicated(parsed: DataFrame) -> DataFrame:
    """Each post once, oldest first."""
    return parsed.filter("code is null").dropDuplicates(["source_id", "external_id"]).orderBy("source_id", "post_id")


def windowed(parsed: DataFrame, before: int | None = None, after: int | None = None) -> DataFrame:
    """Posts strictly older than ``before`` or newer than ``after``; an ``older`` cursor that would not move on is dropped."""
    rows = parsed if before is None else parsed.filter(F.col("post_id") < before)
    rows = rows if after is None else rows.filter(F.col("post_id") > after)
    return rows if before is None else rows.withColumn("older", F.when(F.col("older") < before, F.col("older")))


Transport = Callable[[str], tuple[int, str, bytes]]  # url -> status, final url, body


def fetch(transport: Transport, channel: str, before: int | None = None, after: int | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """One page; waits 15 s, 30 s, ... between attempts when limited or unavailable."""
    for attempt in range(1, MAX_ATTEMPTS + 1):
        status, final, body = transport(preview_url(channel, before, after))
        if status == 429 or status >= 500:
            if attempt == MAX_ATTEMPTS:
                raise SourceError("rate_limited" if status == 429 else "unavailable")
            sleep(BACKOFF_S * attempt)
            continue
        if status == 404:
            raise SourceError("not_found")
        if status != 200:
            raise SourceError("unavailable", str(status))
        if "/s/" not in urlparse(final).path:
            raise SourceError("disabled", "the channel has no preview")
        if len(body) > MAX_BYTES:
            raise SourceError("too_large")
        try:
            return body.decode("utf-8")
        except UnicodeDecodeError as e:
            raise SourceError("malformed", "not UTF-8") from e
    raise AssertionError("unreachable")


def backfill(transport: Transport, channel: str, max_pages: int | None = None, sleep: Callable[[float], None] = time.sleep, before: int | None = None, after: int | None = None) -> Iterator[dict]:
    """From the latest page, or the one before ``before``, back to the first or to ``after``, or ``max_pages``. Posts are strictly within the bounds."""
    pages = 0
    while max_pages is None or pages < max_pages:
        page = parse_preview(channel, fetch(transport, channel, before=before, sleep=sleep))
        kept = [e for i, e in zip(page.ids, page.evidence, strict=True) if (before is None or i < before) and (after is None or i > after)]
        yield from reversed(kept)
        pages += 1
        # older posts have smaller ids than the cursor
        if page.older is None or before is not None and page.older >= before or after is not None and page.older <= after + 1:
            return
        before = page.older


def newest(transport: Transport, channel: str, sleep: Callable[[float], None] = time.sleep) -> int:
    """The newest post of a channel, by one page; 0 if it has none."""
    return max(parse_preview(channel, fetch(transport, channel, sleep=sleep)).ids, default=0)


def poll(transport: Transport, channel: str, after: int, pages: int | None = POLL_PAGES, sleep: Callable[[float], None] = time.sleep, until: int | None = None) -> tuple[list[dict], int]:
    """All posts newer than ``after``, page by page (so many at most), and the newest id; beyond ``until`` no page is fetched."""
    out: list[dict] = []
    while (pages is None or pages > 0) and (until is None or after < until):
        pages = None if pages is None else pages - 1
        page = parse_preview(channel, fetch(transport, channel, after=after, sleep=sleep))
        fresh = [(i, e) for i, e in zip(page.ids, page.evidence, strict=True) if i > after]
        if not fresh:
            break
        out += [e for _, e in fresh]
        after = fresh[-1][0]
    return out, after


def https_transport(url: str) -> tuple[int, str, bytes]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "sentria"}), timeout=30) as r:  # noqa: S310
            return r.status, r.url, r.read(MAX_BYTES + 1)
    except HTTPError as e:
        return e.code, e.url, b""


def folder_transport(folder: str) -> Transport:
    """Pages from files ``<channel>.html``, ``<channel>-before-<n>.html`` and ``<channel>-after-<n>.html``, for tests and replays."""

    def get(url: str) -> tuple[int, str, bytes]:
        parsed = urlparse(url)
        name = parsed.path.rpartition("/")[2] + ("-" + parsed.query.replace("=", "-") if parsed.query else "")
        try:
            with open(f"{folder}/{name}.html", "rb") as f:
                return 200, url, f.read()
        except FileNotFoundError:
            return 404, url, b""

    return get


def _number(e: dict) -> int:
    return int(e["external_id"].rpartition("/")[2])


def _row(e: dict) -> tuple:
    media = [(m["kind"], m["url"]) for m in e["media"]]
    return (e["source_id"], e["external_id"], e["published_at"], e["edited"], e["text"], media, e["forwarded_from"], (e["provenance"]["url"], e["provenance"]["collector"]), _number(e))


class _Channel(InputPartition):
    """A channel, and what of it is read: posts after one and up to another."""

    def __init__(self, name: str, after: int | None = None, until: int | None = None):
        super().__init__(name)
        self.name, self.after, self.until = name, after, until


def _channels(options: dict) -> list[str]:
    return [c.strip() for c in options["channels"].split(",") if c.strip()]


class _Backfill(DataSourceReader):
    """A partition for each channel, read backwards within the bounds."""

    def __init__(self, options: dict):
        self.options = options
        self.before: int | None = None
        self.after: int | None = None

    def partitions(self) -> list[InputPartition]:
        return [_Channel(c) for c in _channels(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        limit = int(self.options["maxpages"]) if "maxpages" in self.options else None
        if self.before is not None and (self.before <= 1 or self.after is not None and self.after + 1 >= self.before):
            return
        yield from map(_row, backfill(_transport(self.options), partition.name, limit, before=self.before, after=self.after))


class _Bounded(_Backfill):
    """The bounds are those that filters on ``post_id`` give."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("post_id",) or not isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bound = f.value + (not isinstance(f, LessThan))
                self.before = bound if self.before is None else min(self.before, bound)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                bound = f.value - (not isinstance(f, GreaterThan))
                self.after = bound if self.after is None else max(self.after, bound)


class _Follow(DataSourceStreamReader):
    """The driver asks each channel for its newest post, one page each; posts are read in the channels' partitions.

    A channel that can't be asked keeps its offset until it can; only if none answers, the stream fails.
    """

    def __init__(self, options: dict):
        self.options = options
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {c: int(self.options.get("after", 0)) for c in _channels(self.options)}

    def latestOffset(self) -> dict:
        failed: SourceError | None = None
        answered = 0
        for channel in _channels(self.options):
            try:
                self.known[channel] = max(newest(_transport(self.options), channel), self.known.get(channel, 0))
                answered += 1
            except SourceError as e:
                failed = e
        if failed and not answered:
            raise failed
        return {c: self.known.get(c, 0) for c in _channels(self.options)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first = int(self.options.get("after", 0))
        return [_Channel(c, start.get(c, first), until) for c, until in end.items() if until > start.get(c, first)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows, _ = poll(_transport(self.options), partition.name, partition.after, None, until=partition.until)
        yield from (_row(e) for e in rows if _number(e) <= partition.until)


def _transport(options: dict) -> Transport:
    return folder_transport(options["folder"]) if "folder" in options else https_transport


class PreviewSource(DataSource):
    """``spark.read.format("preview").option("channels", "a,b")``, and the same with ``readStream``; ``after`` is where a stream begins."""

    @classmethod
    def name(cls) -> str:
        return "preview"

    def schema(self) -> str:
        return f"{EVIDENCE}, post_id long"

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (_Bounded if options.get("pushdown") == "true" else _Backfill)(options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Follow(dict(self.options))
