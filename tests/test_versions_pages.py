import json
import random
import threading

import pytest
from paperloom.session import importable
from paperloom.sinks import tables, versions
from paperloom.sources import paging

COLUMNS = "seq long, title string, citation_count long, quality_score double, doi string, abstract string, pdf_url string, arxiv_id string"


def plain_upsert(old, new):
    """Record by record, in order."""
    norm = lambda t: " ".join((t or "").lower().split())
    table = {r["seq"]: dict(r) for r in old}
    own = {s: {c: r[c] or None for c in ("doi", "arxiv_id")} for s, r in table.items()}
    before = sorted(table)
    led, groups = [], {s: [] for s in before}
    for r in sorted(new, key=lambda r: r["seq"]):
        target = next((s for s in before if norm(table[s]["title"]) == norm(r["title"])), None)
        for c in ("doi", "arxiv_id"):
            if target is None and r[c]:
                target = next((s for s in before if own[s][c] == r[c]), None)
        if target is None:
            for same in (lambda x: r["doi"] and x["doi"] == r["doi"], lambda x: r["arxiv_id"] and x["arxiv_id"] == r["arxiv_id"], lambda x: norm(x["title"]) == norm(r["title"])):
                target = next((x["seq"] for x in led if same(x)), target) if target is None else target
        if target is None:
            table[r["seq"]], target = dict(r), r["seq"]
            own[target] = {c: r[c] or None for c in ("doi", "arxiv_id")}
            led.append(r)
            groups[target] = []
        else:
            groups[target].append(r)
    for s, rows in groups.items():
        t = table[s]
        for r in rows:
            counts = [x for x in (t["citation_count"], r["citation_count"]) if x is not None]
            t["citation_count"] = max(counts, default=None)
            t["quality_score"] = r["quality_score"] if r["quality_score"] is not None else t["quality_score"]
        for c in versions.FILLED:
            t[c] = next((x for x in [t[c], *(r[c] for r in rows)] if x), None)
    for c in ("doi", "arxiv_id"):
        holders = {}
        for s in table:
            if table[s][c]:
                holders.setdefault(table[s][c], []).append((own[s][c] != table[s][c], s))
        for value, found in holders.items():
            for _, s in found:
                if s != min(found)[1]:
                    table[s][c] = None
    return sorted(tuple(r.values()) for r in table.values())


def batch(rng, first, n):
    pick = lambda kind, k: rng.choice([None, "", *(f"{kind}{x}" for x in range(k))])
    return [
        {"seq": first + i, "title": rng.choice([None, *(f"Title  {x}" for x in range(14)), *(f"title {x}" for x in range(14))]), "citation_count": rng.choice([None, 1, 5, 9]), "quality_score": rng.choice([None, 1.0, 2.0]),
         "doi": pick("d", 9), "abstract": pick("a", 3), "pdf_url": pick("p", 3), "arxiv_id": pick("x", 9)} for i in range(n)
    ]


def test_upserts_equal_one_record_at_a_time(spark):
    rng = random.Random(9)
    table = []
    for turn in range(2):
        new = batch(rng, 100 * turn, 14)
        df = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)
        got = versions.upsert(df(table), df(new))
        rows = sorted(tuple(r) for r in got.collect())
        assert rows == [tuple(x if x != "" or c not in versions.FILLED else None for c, x in zip(got.columns, r, strict=True)) for r in plain_upsert(table, new)]
        assert tables.repeated_ids(got).count() == 0
        table = [dict(zip(got.columns, r, strict=True)) for r in rows]


def test_query_equals_one_record_at_a_time(spark, sf):
    from paperloom.plans import studies

    rows = studies.editions(spark, sf).collect()
    table = []
    for turn in range(3):
        new = [{c: r[c] for c in r.asDict() if c != "turn"} for r in rows if r.turn == turn]
        table = [dict(zip([c for c in rows[0].asDict() if c != "turn"], r, strict=True)) for r in plain_upsert(table, new)]
    assert sorted(tuple(r) for r in studies.q_library_upserts(spark, sf).collect()) == [tuple(r.values()) for r in table]


def test_of_two_writers_one_commits(spark, tmp_path):
    path = f"file://{tmp_path}/library"
    df = lambda *rows: spark.createDataFrame([(s, t, 1, 1.0, None, None, None, None) for s, t in rows], COLUMNS)
    assert versions.last_version(spark, path) == 0
    with pytest.raises(ValueError):
        versions.read_version(spark, path)
    assert versions.upsert_into(df((1, "a")), path) == 1
    one, two = versions.read_version(spark, path), df((2, "b"))
    assert versions.commit(one.unionByName(two), path, 1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(one, path, 1)
    assert versions.read_version(spark, path).count() == 2 and versions.read_version(spark, path, 1).count() == 1
    ended = []
    writers = [threading.Thread(target=lambda k=k: ended.append(versions.upsert_into(df((10 + k, f"t{k}")), path, attempts=9))) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(ended) == [3, 4] and sorted(r.seq for r in versions.read_version(spark, path).collect()) == [1, 2, 10, 11]
    assert len(list((tmp_path / "library" / "data").iterdir())) == 4


# -- pages ---------------------------------------------------------------------------------------------------------------


def record(folder, query, sizes, broken=None):
    """Pages of a query with so many items each."""
    cursor, n = paging.FIRST, 0
    for k, size in enumerate(sizes):
        after = f"c{k + 1}" if k + 1 < len(sizes) else None
        reply = {"results": [{"title": f"{query} {n + i}"} for i in range(size)], "meta": {"next_cursor": after}}
        (folder / paging.RecordedPages.file(query, cursor)).write_text(json.dumps({"status": broken[1]} if broken and broken[0] == k else reply))
        cursor, n = after, n + size


def test_pages_are_cut_at_the_limit(spark, tmp_path):
    importable(spark).dataSource.register(paging.RecordedPages)
    record(tmp_path, "one", [3, 3, 3])
    record(tmp_path, "two", [2])
    record(tmp_path, "bad", [2, 2, 2], broken=(1, 500))
    read = lambda limit: spark.read.format("recorded_pages").options(path=str(tmp_path), queries="one\ntwo\nbad\nnone\none", limit=limit, source="s").load()
    titles = lambda df: sorted(json.loads(r.raw)["title"] for r in df.collect())
    whole = [f"one {k}" for k in range(9)] + ["two 0", "two 1", "bad 0", "bad 1"]
    assert titles(read(100)) == sorted(whole)
    assert titles(read(4)) == sorted([*(f"one {k}" for k in range(4)), "two 0", "two 1", "bad 0", "bad 1"])
    assert read(4).rdd.getNumPartitions() == 4 and paging.size_for(30, True) == 60 and paging.size_for(80, True) == 100 and paging.size_for(30, False) == 200


@pytest.mark.parametrize("stops", [[1, 1], [2, 9]])
def test_a_stream_stopped_after_any_page_gives_the_rows_of_one_read(spark, tmp_path, stops):
    importable(spark).dataSource.register(paging.RecordedPages)
    pages, out, state = tmp_path / "pages", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    pages.mkdir()
    record(pages, "one", [3, 2, 4, 1])
    record(pages, "two", [2, 5])
    options = {"path": str(pages), "queries": "one\ntwo", "limit": "8", "source": "s"}
    for n in [*stops, 20]:
        stream = spark.readStream.format("recorded_pages").options(**options).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        for _ in range(600):
            if len([p for p in q.recentProgress if p["numInputRows"]]) >= n or q.recentProgress and not q.status["isDataAvailable"] and q.recentProgress[-1]["numInputRows"] == 0 and len(q.recentProgress) > 1:
                break
            q.awaitTermination(0.1)
        q.stop()
    want = spark.read.format("recorded_pages").options(**options).load()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.read.parquet(out)) == rows(want) and want.count() == 15


def test_only_what_passes_is_asked_again():
    waits, tries = [], []

    def failing(*errors):
        left = list(errors)

        def call():
            tries.append(1)
            if left:
                raise left.pop(0)
            return "found"

        return call

    ask = lambda *errors: paging.requested(failing(*errors), sleep=waits.append)
    assert ask(paging.Refused(429), TimeoutError()) == "found" and waits == [2.0, 4.0]
    for error in (paging.Refused(500), paging.Refused(404), FileNotFoundError(), ZeroDivisionError()):
        tries.clear()
        with pytest.raises(type(error)):
            ask(error)
        assert len(tries) == 1
    with pytest.raises(ConnectionError):
        ask(ConnectionError(), ConnectionError(), ConnectionError())
    assert list(paging.walk(lambda q, c: ([], None), "q", 5)) == [([], None, 0)]


# -- digest --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cuts", [[17], [5, 6, 30]])
def test_any_split_into_batches_gives_the_leaders_of_the_whole(spark, tmp_path, cuts):
    from paperloom.operators import dedup
    from paperloom.streaming import digest

    rng, path = random.Random(5), f"file://{tmp_path}/digest"
    rows = [(r["seq"], r["title"], r["doi"], r["arxiv_id"], None) for r in batch(rng, 0, 40)]
    df = lambda part: spark.createDataFrame(part, "seq long, title string, doi string, arxiv_id string, at timestamp")
    ends = [0, *cuts, len(rows)]
    for number, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        digest.take(df(rows[a:b]), number, path)
        if number == 1:
            digest.take(df(rows[a:b]), number, path)  # run again: nothing changes
    pairs = lambda found: sorted((r.seq, r.leader) for r in found.collect())
    assert pairs(digest.assigned(spark, path)) == pairs(dedup.leaders(df(rows), None))
    assert versions.last_version(spark, path) == len(cuts) + 1


def test_late_records_follow_and_old_leaders_go(spark, tmp_path):
    from datetime import datetime

    from paperloom.streaming import digest

    path, day = f"file://{tmp_path}/digest", lambda d: datetime(2024, 1, d)
    df = lambda *rows: spark.createDataFrame([(s, t, None, None, day(d)) for s, t, d in rows], "seq long, title string, doi string, arxiv_id string, at timestamp")
    digest.take(df((50, "a", 1), (51, "b", 9)), 0, path, horizon="5 days")
    digest.take(df((3, "b", 9), (4, "a", 9)), 1, path, horizon="5 days")
    assert sorted((r.seq, r.leader) for r in digest.assigned(spark, path).collect()) == [(3, 51), (4, 4), (50, 50), (51, 51)]
    assert sorted(r.seq for r in versions.read_version(spark, path).collect()) == [4, 51]
