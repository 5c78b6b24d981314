"""Cases in which queries differed from their SQL, and batches of pages that took memory in proportion to the batch."""

import tracemalloc

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewtrust.functions import display as DI
from reviewtrust.operators import prompts as PR
from reviewtrust.operators import sample as SA
from reviewtrust.sources import html as H


def _against_sql(spark, folder, name, tables):
    """Rows of a query and of its SQL over the tables given."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register("rows", rows)
        con.execute(f"copy (select * from rows) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = [tuple(dict(zip(names, r))[c] for c in df.columns) for r in cur.fetchall()]
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


def test_views_round_as_printf_does(spark):
    counts = [1_000_000, 1_050_000, 1_150_000, 1_250_000, 1_350_000, 4_250_000, 4_350_000, 9_950_000, 9_949_999, 12_750_000, 999_950_000, 123_456_750_000, 9_007_199_254_740_993]
    counts += [1_000_000 + 50_000 * k for k in range(200)]
    rows = spark.createDataFrame([(c,) for c in counts], "n bigint").select("n", DI.views(F.col("n")).alias("v")).collect()
    assert {r["n"]: r["v"] for r in rows} == {c: "%.1fM views" % (c / 1e6) for c in counts}


def test_a_small_product_may_take_turns_too(spark):
    df = spark.createDataFrame([(1, k, "s", 5.0 if k < 4 else 1.0) for k in range(6)], "product_id bigint, review_id bigint, source string, rating double")

    def order(**how):
        return [r["review_id"] for r in SA.stratified_sample(df, limit=10, **how).orderBy("position").collect()]

    assert order() == [0, 1, 2, 3, 4, 5]
    assert order(whole_in_order=False) == [4, 0, 5, 1, 2, 3]


def test_character_references_of_stored_pages_as_in_sql(spark, tmp_path):
    heads = ["A &amp; b &quot;c&quot; les&amp;&amp", "plain", "x &lt; y&am", "AT&T &eacute;&#39"]
    html = [f"<html><head><title>{h}</title></head><body><h1>{h}</h1><p>t</p><a href='?a=1&b=2'>l</a></body></html>" for h in heads]
    pages = pa.table({"page_id": list(range(4)), "url": [f"https://shop.example/x/{k}?a=1&b=2" for k in range(4)], "html": html})
    for name in ("page_structure", "page_identity"):
        got, want = _against_sql(spark, tmp_path, name, {"pages": pages})
        assert got == want and len(got) == 4


def test_a_page_that_declares_a_review_too_short_to_keep(spark, tmp_path):
    texts = ["A whole text of one review, long enough.", "Thtion.", "Éaux.", "Thtion.", "short", "ok", "A text that is long.", "Ten chars."] * 2
    documents = pa.table({"doc_id": list(range(16)), "text": texts})
    got, want = _against_sql(spark, tmp_path, "page_reviews", {"documents": documents})
    assert got == want and not [r for r in got if r[0] == 3]


def test_a_short_text_is_shown_as_the_whole_would_be(spark):
    texts = ["word " * 200, "a" * 700, "a" * 701, "a" * 699 + " b", "a" * 700 + " b c", "a" * 698 + "  b  c  d", " x " * 500, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, text string")
    rows = rows.withColumns({"position": F.lit(1), "source": F.lit("s"), "rating": F.lit(1.0), "review_date": F.lit(None).cast("date"), "verified_purchase": F.lit(True), "title": F.lit(None).cast("string"), "helpful_votes": F.lit(0), "author": F.lit("a")})
    whole, short = ([r["l"] for r in df.orderBy("review_id").select(PR.review_line().alias("l")).collect()] for df in (rows, PR.shortened(rows)))
    assert whole == short


def test_nodes_of_a_batch_are_not_all_python_objects_at_once(monkeypatch):
    monkeypatch.setattr(H, "SLICE_CHARS", 20_000)
    page = "<div>" + "<p>a</p>" * 2500 + "</div>"

    def peak(pages):
        tracemalloc.start()
        found = H._in_slices(pa.array([page] * pages), H._parse, H._ARROW_NODES)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == pages and len(found[pages - 1]) == 5001
        return top

    assert peak(12) < 1.5 * peak(1)
