"""A remote listing as a data source: ranges of the update time, read in parallel, batch or stream.

The service lists assets by page within a range of update times. Ranges are halved
until the assets of each fit one task; assets that share one instant (a bulk
update) can't be parted by time, so their pages are dealt out in blocks.

A stream's offset is an instant: a trigger reads what was updated before now (less a
lag that covers clocks and late commits) and not before the last trigger's instant.
So offsets have one size, the driver lists nothing, and assets with equal times
always fall on one side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TICK = timedelta(milliseconds=1)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

# (page, size, after, before) -> {"items": [{"id", "updated_at"}], "next_page": int | None}: assets with
# after <= updated_at < before; None is no bound, and without a lower one undated assets belong too.
FetchPage = Callable[[int, int, str | None, str | None], dict]


def stamp(t: datetime | None) -> str | None:
    return None if t is None else t.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def instant(text: str | None) -> datetime | None:
    if not text:
        return None
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


class Pages(InputPartition):
    """Pages first to last (None: to the end) of a range of update times."""

    def __init__(self, after: str | None, before: str | None, first: int = 1, last: int | None = None):
        self.after, self.before, self.first, self.last = after, before, first, last


def split(fetch: FetchPage, size: int, most: int, after: datetime | None, before: datetime | None, now: datetime) -> list[Pages]:
    """Ranges of at most ``most`` assets (whole pages); instants with more come as blocks of pages. Empty ranges are left out."""
    pages = max(1, most // size)
    out: list[Pages] = []
    todo = [(after, before)]
    while todo:
        lo, hi = todo.pop()

        def holds(page: int, lo=lo, hi=hi) -> bool:
            return bool(fetch(page, size, stamp(lo), stamp(hi))["items"])

        if not holds(1):
            continue
        if not holds(pages + 1):
            out.append(Pages(stamp(lo), stamp(hi)))
        elif (middle := _middle(lo, hi, now)) is not None:
            todo += [(middle, hi), (lo, middle)]
        else:
            first = 1
            while holds(first):
                out.append(Pages(stamp(lo), stamp(hi), first, first + pages - 1))
                first += pages
    return out


def _middle(lo: datetime | None, hi: datetime | None, now: datetime) -> datetime | None:
    """An instant inside the range, or None if it can't be parted: open ends reach to the epoch and to now."""
    if hi is None:
        return now if lo is None or lo < now else None
    if lo is None:
        return hi - max(TICK, (hi - EPOCH) / 2) if hi > EPOCH else None
    ticks = (hi - lo) // TICK
    return lo + ticks // 2 * TICK if ticks > 1 else None


class _Reader(DataSourceReader):
    def __init__(self, fetch: FetchPage, size: int, most: int, since: str | None, clock: Callable[[], datetime]):
        self.fetch, self.size, self.most, self.since, self.clock = fetch, size, most, since, clock

    def partitions(self) -> list[InputPartition]:
        return split(self.fetch, self.size, self.most, instant(self.since), None, self.clock())

    def read(self, partition: Pages) -> Iterator[tuple]:
        page: int | None = partition.first
        while page is not None and (partition.last is None or page <= partition.last):
            got = self.fetch(page, self.size, partition.after, partition.before)
            for item in got["items"]:
                yield item["id"], item.get("updated_at")
            page = got.get("next_page")


class _StreamReader(DataSourceStreamReader):
    """Offsets are {"before": instant}; undated assets come with the first trigger of a stream without ``since``."""

    def __init__(self, fetch: FetchPage, size: int, most: int, since: str | None, clock: Callable[[], datetime], lag: timedelta):
        self.fetch, self.size, self.most, self.since, self.clock, self.lag = fetch, size, most, since, clock, lag
        self.latest: str | None = None  # of this run; unknown after a restart

    def initialOffset(self) -> dict:
        return {"before": self.since or ""}

    def latestOffset(self) -> dict:
        now = stamp(self.clock() - self.lag)
        if self.latest is None:  # the first call of this run: Spark knows where the last one ended
            self.latest = max(now, self.since or "")
        elif now > self.latest and self.fetch(1, 1, self.latest or None, now)["items"]:
            self.latest = now
        return {"before": self.latest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["before"] > end["before"]:
            raise ValueError(f"the clock is behind the last trigger's: {end['before']} after {start['before']}")
        if start["before"] == end["before"]:
            return []
        before = instant(end["before"])
        return split(self.fetch, self.size, self.most, instant(start["before"]), before, before)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _Reader.read(self, partition)

    def commit(self, end: dict) -> None:
        pass


def now_utc() -> datetime:
    return datetime.now(UTC)


def paged_listing(fetch: FetchPage, size: int = 250, most: int = 10_000, clock: Callable[[], datetime] = now_utc, lag: timedelta = timedelta(0)) -> type[DataSource]:
    """A data source "paged_assets" (id, updated_at); option since gives the first update time that is wanted.

    A partition has up to ``most`` assets. ``fetch`` must be sendable to workers.
    """

    class PagedAssets(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_assets"

        def schema(self) -> str:
            return "id string, updated_at string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, size, most, self.options.get("since"), clock)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(fetch, size, most, self.options.get("since"), clock, lag)

    return PagedAssets


def album_list(raw):
    """(id, name, asset_count) of a service's albums, one JSON object per row (column value); a missing name is "", a missing count 0."""
    from pyspark.sql import functions as F

    field = lambda k: F.get_json_object("value", f"$.{k}")
    return raw.select(field("id").alias("id"), F.coalesce(field("albumName"), F.lit("")).alias("name"), F.coalesce(field("assetCount").cast("long"), F.lit(0).cast("long")).alias("asset_count"))
