"""The listing as a stream: no post twice or lost, whatever is cut short or runs again."""

import json

import pytest

from larder.streaming import listing


def write(folder, posts, size=3, cut=None):
    """Pages of `size` posts, newest first; pages from `cut` on are missing."""
    for f in folder.glob("*.json"):
        f.unlink()
    posts = sorted(posts, key=lambda p: (-p[1], p[0]))
    pages = [posts[i : i + size] for i in range(0, len(posts), size)] or [[]]
    for k, page in enumerate(pages):
        if cut is None or k < cut:
            data = {"children": [{"kind": "t3", "data": {"id": i, "created_utc": t, "score": 5}} for i, t in page] + [{"data": {"id": ""}}, 3], "after": f"p{k + 1}" if k + 1 < len(pages) else None}
            (folder / f"{'first' if k == 0 else f'p{k}'}.json").write_text(json.dumps({"data": data}))


@pytest.fixture
def run(spark, tmp_path):
    spark.dataSource.register(listing.Listing)
    place = tmp_path / "place"
    place.mkdir()

    def go(fail=False):
        stream = spark.readStream.format("listing").option("path", f"file://{place}").option("captures", f"file://{tmp_path}/captures").option("pages", "4").load()

        def keep(rows, batch):
            got = [r.id for r in rows.collect()]
            if fail:
                raise RuntimeError("lost")
            (tmp_path / f"batch-{batch}").write_text("\n".join(got))

        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/checkpoint").foreachBatch(keep).start()
        if fail:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination(60)
        else:
            query.awaitTermination(60)
        return sorted(x for f in tmp_path.glob("batch-*") for x in f.read_text().split())

    return place, go


def test_no_post_twice_or_lost(run):
    place, go = run
    first = [(f"a{i}", 100.0 + i // 2) for i in range(8)]
    write(place, first)
    assert go() == sorted(i for i, _ in first) and go() == sorted(i for i, _ in first)
    more = first + [("tie", 103.0), ("b1", 104.0)]
    write(place, more)
    with_more = go()
    assert with_more == sorted(i for i, _ in more)
    many = [*more, *((f"c{i:02d}", 200.0 + i) for i in range(14))]  # more than the pages of a scan
    write(place, many)
    assert go() == with_more  # truncated: nothing is taken, and the boundary stays
    write(place, many, size=6)
    assert go() == sorted(i for i, _ in many)
    later = [*many, ("d", 300.0)]
    write(place, later, cut=0)
    assert go() == sorted(i for i, _ in many)  # the first page is missing
    write(place, later)
    go(fail=True)
    write(place, [("e", 400.0), ("d", 300.0), ("old", 1.0)])  # the failed batch's posts may have left the listing, too
    assert go() == sorted([i for i, _ in later]) or go() == sorted([i for i, _ in later] + ["e"])
    assert go() == sorted([i for i, _ in later] + ["e"])


def test_scan_bounds():
    pages = {None: ([{"id": "b", "created_utc": 2}, {"id": "a", "created_utc": 2}], "x"), "x": ([{"id": "a", "created_utc": 2}, {"id": "z", "created_utc": 1}], None)}
    fetch = lambda place, after: pages[after]
    ids = lambda *args: ([p["id"] for p in listing.scan(fetch, "", *args)[0]], listing.scan(fetch, "", *args)[1])
    assert ids({"at": None, "ids": []}) == (["z", "a", "b"], True)
    assert ids({"at": 2, "ids": ["a"]}) == (["b"], True)
    assert ids({"at": 0, "ids": []}, 1) == ([], False)
