"""Good and bad branches at depth, ties, and long urls."""

from axiomata.llm import url_filters


def test_deep_branches(shared):
    deep = "x://deep.org/a/b/c/d/e/f/g/h"
    rows = [(k, f"{deep}/ads/{k}") for k in range(60)] + [(k, f"{deep}/ok/{k}") for k in range(100, 200)]
    labels = [(k, int(k >= 100), 0) for k, _ in rows]
    pages = shared.createDataFrame(rows, "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filters.filtered(pages, shared.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {found[k] for k in range(60)} == {"block"}
    assert {found[k] for k in range(100, 200)} == {"allow"}


def test_branches_that_differ_only_below(shared):
    """Parents whose rates are alike aren't merged over branches that differ: what is bad in one section is good in the other."""
    rows = [(k, f"x://h.org/{'ab'[k % 2]}/{'xy'[k // 2 % 2]}/{k}") for k in range(400)]
    bad = {k for k, u in rows if "/a/x/" in u or "/b/y/" in u}
    pages = shared.createDataFrame(rows, "page_id long, url string")
    labels = shared.createDataFrame([(k, 0 if k in bad else 1, 0) for k, _ in rows if k % 3], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in url_filters.filtered(pages, labels).collect()}
    assert {k for k in found if found[k]["verdict"] == "block"} == bad
    assert {found[k]["template"] for k in bad} == {"/a/x/*", "/b/y/*"}


def test_branches_alike_are_merged_and_ties_repeat(shared):
    rows = [(k, f"x://h.org/{'abcd'[k % 4]}/{k}") for k in range(200)] + [(7, "x://h.org/d/7")] * 2
    pages = shared.createDataFrame(rows, "page_id long, url string")
    labels = shared.createDataFrame([(k, int(k // 4 % 2 == 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    found = url_filters.filtered(pages, labels).collect()
    assert len(found) == 202
    assert {r["template"] for r in found} == {"/*/*"}
    assert len({(r["verdict"], r["bad_rate"]) for r in found}) == 1


def test_long_urls(shared):
    long = "x://h.org/" + "/".join(f"s{k}" for k in range(300)) + "/" + "q" * 50_000
    pages = shared.createDataFrame([(1, long), (2, "x://h.org/a")], "page_id long, url string")
    labels = shared.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in url_filters.filtered(pages, labels).collect()}
    assert found[1]["path"] == long[len("x://h.org") :]
    assert found[1]["template"].count("/") == 301
