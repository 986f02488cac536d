"""A listing that is read newest first, as a streaming source whose offset is the listing's boundary.

A scan reads pages until it meets a post of the scan before. What is new is written as a capture, with the boundary that
it makes, before Spark hears of it; batches read captures, never the listing, so a batch that runs again sees the same
posts. A truncated scan, whose pages end or whose limit is reached before the boundary although the listing goes on,
makes no capture and moves no boundary: its posts come with the next whole scan. Captures are the source's memory, so
one folder of them belongs to one query.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Pages that a scan reads at most.
PAGES = 50
SCHEMA = "id string, created double, score long, body string"

Page = tuple[list[dict], str | None]
#: Reads one page (None: the first) of a place: its posts, newest first, and the token of the next page.
Fetch = Callable[[str, str | None], Page]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def captured_page(place: str, after: str | None) -> Page:
    """A page of a listing that lies in a folder, as <token>.json or first.json, in the form that the site sends; a missing one is empty."""
    store, root = _open(place)
    name = f"{root}/{after or 'first'}.json"
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return [], after
    data = json.loads(store.open_input_stream(name).readall())["data"]
    posts = [c["data"] for c in data.get("children", []) if isinstance(c, dict) and isinstance(c.get("data"), dict)]
    return [p for p in posts if isinstance(p.get("id"), str) and p["id"] and isinstance(p.get("created_utc"), (int, float))], data.get("after")


def scan(fetch: Fetch, place: str, boundary: dict, pages: int = PAGES) -> tuple[list[dict], bool]:
    """The posts after the boundary, each once, oldest first, and whether the scan was whole.

    boundary has `at`, the time of the newest post seen (None before the first scan, which ends at the listing's end), and
    `ids`, the posts of that time. Ties are new unless they are among these.
    """
    found: dict[str, dict] = {}
    after, at = None, boundary["at"]
    for _ in range(pages):
        posts, after = fetch(place, after)
        if not posts and after is not None:
            return [], False  # a page that should be there is not
        for p in posts:
            if at is None or p["created_utc"] > at or (p["created_utc"] == at and p["id"] not in boundary["ids"]):
                found.setdefault(p["id"], p)
        if after is None or (at is not None and any(p["created_utc"] < at for p in posts)):
            return sorted(found.values(), key=lambda p: (p["created_utc"], p["id"])), True
    return [], False


class Capture(InputPartition):
    def __init__(self, number: int):
        self.number = number


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.fetch, self.place, self.pages = fetch, options["path"], int(options.get("pages", PAGES))
        self.captures = options["captures"].rstrip("/")

    def _last(self) -> int:
        store, root = _open(self.captures)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _read(self, number: int) -> dict:
        store, root = _open(self.captures)
        return json.loads(store.open_input_stream(f"{root}/{number}.json").readall()) if number else {"at": None, "ids": [], "posts": []}

    def initialOffset(self) -> dict:
        return {"capture": 0}

    def latestOffset(self) -> dict:
        number = self._last()
        boundary = self._read(number)
        posts, whole = scan(self.fetch, self.place, boundary, self.pages)
        if whole and posts:
            at = posts[-1]["created_utc"]
            ids = [p["id"] for p in posts if p["created_utc"] == at] + (boundary["ids"] if at == boundary["at"] else [])
            store, root = _open(self.captures)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{number + 1}.tmp") as out:
                out.write(json.dumps({"at": at, "ids": ids, "posts": posts}).encode())
            store.move(f"{root}/{number + 1}.tmp", f"{root}/{number + 1}.json")  # a capture is there whole or not at all
            number += 1
        return {"capture": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Capture(n) for n in range(start["capture"] + 1, end["capture"] + 1)]

    def read(self, partition: Capture) -> Iterator[tuple]:
        for p in self._read(partition.number)["posts"]:
            score = p.get("score")
            yield p["id"], float(p["created_utc"]), score if isinstance(score, int) else 0, json.dumps(p)


class Listing(DataSource):
    """spark.readStream.format("listing").option("path", place).option("captures", folder), after spark.dataSource.register(Listing).

    fetch reads a page of the place; a subclass may read from a site.
    """

    fetch = staticmethod(captured_page)

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options, self.fetch)
