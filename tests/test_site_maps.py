"""Site maps followed level by level, against a plain walk."""

import random
from collections import defaultdict

from larder.sources import feeds

AT = "https://s.com/"


def index(children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{AT}{c}</loc>{f'<lastmod>2024-01-{d:02d}</lastmod>' if d else ''}</sitemap>" for c, d in children) + "</sitemapindex>"


def walk(roots, maps, most, levels):
    """(source, page) with repeats; maps: name -> (children, pages)."""
    out = []
    for source in {s for s, _ in roots}:
        frontier = {u for s, u in roots if s == source}
        read, allowed = set(), len(frontier) + most
        for level in range(levels + 1):
            best = defaultdict(lambda: (99, 99))
            for u in frontier:
                children, pages = maps.get(u, ([], []))
                out += [(source, AT + p) for p in pages]
                order = sorted(range(len(children)), key=lambda i: (-children[i][1], i))
                for k, i in enumerate(order[:most], 1):
                    best[children[i][0]] = min(best[children[i][0]], (k, i))
            read |= frontier
            turn = sorted((at, AT + c) for c, at in best.items() if c not in read)
            frontier = {u.removeprefix(AT) for _, u in turn[: max(0, allowed - len(read))]}
            if level == levels:
                break
    return sorted(out)


def test_against_a_plain_walk(spark):
    pick = random.Random(5)
    names = [f"m{i}" for i in range(14)]
    for most, levels in ((2, 1), (4, 3), (30, 6)):
        maps = {n: ([(pick.choice(names), pick.randint(0, 9)) for _ in range(pick.randint(0, 4))], [f"p{n}{i}" for i in range(pick.randint(0, 2))]) for n in names[:-1]}
        maps = {n: (c, []) if c else ([], p) for n, (c, p) in maps.items()}
        roots = [(1, "m0"), (1, "m1"), (2, "m2"), (3, "m13"), (1, "m0")]
        documents = [(AT + n, index(c) if c else "<urlset>" + "".join(f"<url><loc>{AT}{x}</loc></url>" for x in p) + "</urlset>") for n, (c, p) in maps.items()]
        documents = spark.createDataFrame([*documents, (AT + "m13", "<broken"), (None, None)], "url string, xml string")
        found = feeds.follow_sitemaps(spark.createDataFrame([(s, AT + u) for s, u in roots], "source_id long, url string"), documents, most=most, levels=levels)
        assert sorted((r.source_id, r.url) for r in found.collect()) == walk(roots, maps, most, levels)
    plan = found._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "Join" not in plan  # what a level found is read, not found again


def test_no_maps(spark):
    none = spark.createDataFrame([], "source_id long, url string")
    assert feeds.follow_sitemaps(none, spark.createDataFrame([], "url string, xml string")).isEmpty()
