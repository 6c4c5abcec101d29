import hashlib
import random

import duckdb
import pytest

from loreloom.llm.fixity import ORACLE, audit, audit_pages, tree
from loreloom.llm.queries import op8_merkle_audit

SCHEMA = "file bigint, offset bigint, length bigint, digest string"


def plain(left, right):
    """Records in which two digest tables differ, by comparing all."""
    places = {(r[0], r[1]) for r in left + right}
    out = []
    for place in places:
        a, b = ([r[2:] for r in side if r[:2] == place] for side in (left, right))
        for x in list(a):
            if x in b:
                a.remove(x)
                b.remove(x)
        a.sort()
        b.sort()
        for k in range(max(len(a), len(b))):
            x, y = (s[k] if k < len(s) else None for s in (a, b))
            fault = "lost" if y is None else "foreign" if x is None else "resized" if x[0] != y[0] else "changed"
            out.append((*place, x and x[0], y and y[0], fault))
    return sorted(out, key=str)


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_audit_finds_all_differences(spark, seed):
    rng = random.Random(seed)
    left = []
    for file in range(6):
        at = 0
        for k in range(rng.randint(1, 120)):
            n = rng.randint(1, 400)
            left.append((file, at, n, digest((file, k))))
            at += n
    left.append(left[0])
    right = [r for r in left if rng.random() > 0.03 and r[0] != 5]
    right = [(*r[:3], digest("x")) if rng.random() < 0.03 else (*r[:2], r[2] + 1, r[3]) if rng.random() < 0.02 else r for r in right]
    right += [(9, 0, 5, digest("new")), (0, 10**6, 7, digest("far")), left[3]]
    got = audit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), range_bytes=512, fanout=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain(left, right)


def test_equal_replicas_stop_at_the_roots(spark):
    rows = [(f, i * 100, 100, digest((f, i))) for f in range(3) for i in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    levels = tree(frame, 256, 4)
    assert [x.count() for x in levels][-1] == 3 and len(levels) > 2
    assert audit(frame, frame, 256, 4).count() == 0


def test_empty_sides(spark):
    rows = spark.createDataFrame([(0, 0, 4, digest(1)), (None, None, 4, digest(1))], SCHEMA)
    assert {r.fault for r in audit(rows, rows.limit(0)).collect()} == {"lost"}
    assert {r.fault for r in audit(rows.limit(0), rows).collect()} == {"foreign"}
    assert audit(rows.limit(0), rows.limit(0)).count() == 0


def test_pages(spark):
    html = "é<p>" * 50_000
    rows = [(i, f"http://h/{i}", "<p>" * (i % 40), 1) for i in range(700)] + [(None, None, None, 1), (None, "u", "x", 1), (5, "http://h/5", "again", 1), (900, "u", html, 1)]
    found = audit_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, file int").repartition(3)).collect()
    dice = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 97 for i, *_ in rows if i is not None}
    wanted = sorted((i, {10: "lost", 11: "changed", 12: "resized"}[dice[i]]) for i, *_ in rows if i is not None and 10 <= dice[i] <= 12)
    assert sorted((r.page_id, r.fault) for r in found) == wanted and len(wanted) > 5
    assert audit_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_sql_gives_the_same(spark):
    got = sorted(map(tuple, op8_merkle_audit(spark, "/root/testdata/sf0.1").collect()))
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.1/pages.parquet'")
    assert got == sorted(con.execute(ORACLE).fetchall()) and len(got) > 20
