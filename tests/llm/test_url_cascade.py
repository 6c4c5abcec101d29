import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.llm.queries import op4_bloom_cascade
from loreloom.llm.url_cascade import AD_HOST, ORACLE, RULES, Level, build, judge_pages, listed, with_membership


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if re.search(AD_HOST, host) else "allow"


URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "http://example.net/en", "https://example.net/en/", "x://net", "x://net/",
        "x://notnet/", "x://a.net?/", "http://sub.example.com/de/1", "http://sub.example.com/DE/1", "http://w.org/fr/", "http://w.org/fr",
        "http://ads.site.com/", "http://m.ads-track.example.com/en/1", "http://bads.com", "http://tracker.a/b://c", "HTTP://É.net/é", "http://u@H:80/p",
        "http://" + "long" * 5000 + ".net/", "http://a\nb.net/x\ny"]


@pytest.mark.parametrize("most_bytes", [64 << 20, 8])
def test_verdicts(spark, most_bytes):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], "x"), (4, URLS[4], "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, host string").repartition(3)
    got = sorted((-1 if r[0] is None else r[0], *r[1:3], r[3] or "", r[4]) for r in judge_pages(frame, most_bytes=most_bytes).collect())
    wanted = sorted((-1 if i is None else i, *plain(u)[:2], plain(u)[2] or "", plain(u)[3]) for i, u, _ in rows)
    assert got == wanted


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
@pytest.mark.parametrize("most_bytes", [64 << 20, 500])
def test_membership_is_exact(spark, share, most_bytes):
    rng = random.Random(7)
    chosen = {i for i in range(3000) if rng.random() < share}
    frame = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").isin(*chosen or [-1]).alias("wanted"))
    ids = F.substring("key", 2, 9).cast("bigint")
    if share == 1.0 and most_bytes == 500:
        most_bytes = 5000
    got = with_membership(frame, "key", ids.isin(*chosen or [-1]), "got", most_bytes)
    assert got.count() == 3000 and got.where("wanted != got").count() == 0


def test_levels_alternate(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), (F.col("id") % 10 == 0).alias("listed"))
    levels = build(keys)
    assert len(levels) > 2 and [x.number for x in levels] == list(range(len(levels)))
    rows = keys.toPandas()
    first, second = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    assert (levels[0].holds(first, second) >= rows["listed"]).all()
    assert (listed(levels, first, second) == rows["listed"]).all()
    assert sum(x.bits for x in levels) < 4000 * 3


def test_empty_filter_holds_nothing():
    level = Level.sized(0, 0, 0.5)
    level.words = np.zeros(1, np.uint64)
    assert not level.holds(np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64)).any()


def test_empty_table(spark):
    assert judge_pages(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_sql_gives_the_same(spark):
    got = sorted(map(tuple, op4_bloom_cascade(spark, "/root/testdata/sf0.01").collect()), key=lambda r: r[0])
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    assert got == sorted(con.execute(ORACLE).fetchall(), key=lambda r: r[0])
