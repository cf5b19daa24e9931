"""The core queries against their SQL in DuckDB on the smallest tables, and literal cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cartolake.operators import classify, mentions, refresh, urls
from cartolake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def of(v):
        return "" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(of(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(expected)


def test_identity_prefers_the_resolved_url(spark):
    long = "ChIJ" + "x" * 23
    pairs = [
        ("https://maps.app.goo.gl/abc", f"https://www.google.com/maps/place/x/data=!1s{long}"), ("https://goo.gl/maps/q1", None), (f"https://x/?ftid={long}", "https://x/data=!16s%2Fg%2F11b"),
        (f"https://x/?ftid={long}", "https://x/data=!1s0x31:0x5a"), ("https://x/?cid=123", "https://x/maps?ftid=0x1:0x2"), ("https://x/?cid=", "https://x/data=!1s0x31:0x5a"), ("https://x/a!1sChIJshort", ""),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string")
    found = [r[0] for r in rows.select(urls.parse_place_identity(F.col("a"), F.col("b"))).collect()]
    assert found[:-1] == [long, "short:q1", "g:11b", long, "cid:123", "0x31:0x5a"] and found[-1].startswith("url:")


def test_refs_that_meet_new_ones(spark):
    refs = ["a", "a", "a-0002", "a-0002", "", "social-0005", "x" * 200, "x" * 130, None]
    rows = spark.createDataFrame([("p", k, r) for k, r in enumerate(refs)] + [("q", 0, "a"), ("q", 1, "a")], "post_id string, pos int, candidate_ref string")
    found = {(r.post_id, r.pos): r.ref for r in mentions.unique_refs(rows).collect()}
    want, used = [], set()
    for k, r in enumerate(refs, 1):
        base = ((r or "").strip() or f"social-{k:04d}")[:128]
        tails = ["", f"-{k:04d}", *(f"-{k:04d}-{n}" for n in range(2, 20))]
        ref = next(x for x in (base[: 128 - len(t)] + t for t in tails) if x not in used)
        used.add(ref)
        want.append(ref)
    assert [found["p", k] for k in range(len(refs))] == want and [found["q", k] for k in range(2)] == ["a", "a-0002"]


def test_language_is_forced_once(spark):
    rows = spark.createDataFrame([("https://www.google.com/maps?hl=vi&q=1",), ("https://example.com/?hl=vi",)], "u string")
    assert [r.u for r in urls.force_language(rows, "u").collect()] == ["https://www.google.com/maps?q=1&hl=en", "https://example.com/?hl=vi"]


def test_upscaled_image(spark):
    row = spark.createDataFrame([("https://lh3.googleusercontent.com/p/x=w100-h80-k",)], "u string")
    assert row.select(urls.upscale_image(F.col("u"))).first()[0].endswith("=w1000-h800-k")


def test_numbers(spark):
    row = spark.createDataFrame([("4,5 sao", "1.234 reviews"), ("none", None)], "a string, b string")
    assert [tuple(r) for r in row.select(classify.first_float(F.col("a")), classify.first_int(F.col("b"))).collect()] == [(4.5, 1234), (None, None)]


def test_a_raised_row_leaves_the_streak(spark):
    rows = spark.createDataFrame([(1, 1, True, False), (1, 2, False, True), (1, 3, True, False), (1, 4, False, False), (1, 5, True, False)], "worker int, seq int, blocked boolean, raised boolean")
    assert [(r.streak, r.wait_s) for r in refresh.block_streaks(rows).orderBy("seq").collect()] == [(1, None), (1, None), (2, 60), (0, None), (1, None)]


def test_query_text_takes_new_hints_only(spark):
    row = spark.createDataFrame([("Pho Hoa Hanoi", "hanoi", "Vietnam", None)], "query string, a string, b string, c string")
    assert mentions.map_query(row, ["a", "b", "c"]).first().map_query == "Pho Hoa Hanoi Vietnam"
