"""Shape of the plans, the one-scan table, the stream."""

import contextlib
import glob
import io
import os
import re

import pytest

import __spark_entry__ as contract
from helpers import tuples
from pagesieve import operators as op
from pagesieve import plans
from pagesieve.sources import read_pages
from rendered import HOURS_PATTERN, PRICE_PATTERN, rendered_pages
from pagesieve.streaming import append_facts, stream_pages

SF = "/root/testdata/sf0.001"
ROW_JOBS = {
    "metadata": op.page_metadata,
    "named meta": op.named_meta_tags,
    "links": op.page_links,
    "text": op.page_text,
    "prices": lambda p: op.price_rows(p, PRICE_PATTERN),
    "hours": lambda p: op.opening_hours(p, HOURS_PATTERN),
    "facts": plans.page_facts,
}


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ROW_JOBS)
def test_row_jobs_do_not_shuffle_and_read_two_columns(spark, name):
    plan = _plan(ROW_JOBS[name](read_pages(spark, f"{SF}/pages.parquet")))
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


@pytest.mark.parametrize("by", ["kind", "host"])
def test_counts_shuffle_once_after_partial_sums(spark, by):
    plan = _plan(op.link_counts(read_pages(spark, f"{SF}/pages.parquet"), by))
    assert "ReadSchema: struct<html:string>" in plan
    operators = re.findall(r"^\(\d+\) (\S+)", plan, flags=re.M)
    assert operators.count("Exchange") == 1
    assert operators.index("HashAggregate") < operators.index("Exchange")
    assert "partial_sum" in plan


def test_filter_reaches_the_scan(spark):
    pages = read_pages(spark, f"{SF}/pages.parquet")
    plan = _plan(op.page_text(pages.filter("page_id < 10")))
    assert "LessThan(page_id,10)" in plan


#: Joins and sessions, which bring rows of a key together.
KEYED = {
    "broken_links", "broken_targets", "orders_at_events", "overlapping_order_spans", "latest_order_before_event", "user_sessions",
}


def test_registered_page_queries_shuffle_for_counts_only(spark):
    for name in contract.library_queries().keys() - KEYED:
        query = contract.library_queries()[name]
        exchanges = len(re.findall(r"^\(\d+\) Exchange", _plan(query(spark, SF)), flags=re.M))
        assert exchanges == ("counts" in name), name


@pytest.mark.parametrize("name", sorted(KEYED))
def test_keyed_queries_have_no_nested_loop(spark, name):
    plan = _plan(contract.library_queries()[name](spark, SF))
    assert "Exchange" in plan
    assert not re.search("NestedLoop|Cartesian|EvalPython|InPandas|InArrow", plan)


def test_partitions_are_the_callers_choice(spark):
    path = f"{SF}/pages.parquet"
    assert read_pages(spark, path, 5).rdd.getNumPartitions() == 5
    assert "Exchange" not in _plan(read_pages(spark, path))


@pytest.fixture(params=["pages", "rendered"])
def crawl(spark, request):
    if request.param == "pages":
        return read_pages(spark, f"{SF}/pages.parquet")
    return rendered_pages(spark.read.parquet(f"{SF}/part.parquet"))


def _same_outputs(facts, pages):
    assert tuples(plans.facts_metadata(facts)) == tuples(op.page_metadata(pages))
    assert tuples(plans.facts_named_meta(facts)) == tuples(op.named_meta_tags(pages))
    assert tuples(plans.facts_links(facts)) == tuples(op.page_links(pages))
    assert tuples(plans.facts_text(facts)) == tuples(op.page_text(pages))
    for by in ("kind", "host"):
        assert tuples(plans.facts_link_counts(facts, by)) == tuples(op.link_counts(pages, by))


def test_one_scan_gives_the_same_outputs(spark, crawl, tmp_path):
    facts = plans.store_facts(plans.page_facts(crawl), str(tmp_path / "facts"))
    _same_outputs(facts, crawl)
    plan = _plan(plans.facts_link_counts(facts, "host"))
    assert "ReadSchema: struct<hrefs:array<string>>" in plan


def test_facts_go_to_the_shared_folder(spark):
    facts = plans.page_facts(read_pages(spark, f"{SF}/pages.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(f"{shared}/page_facts-" in path for path in plans.store_facts(facts).inputFiles())


def test_stream_takes_each_file_once(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    pages = read_pages(spark, f"{SF}/pages.parquet")
    for batch in ("page_id < 20", "page_id >= 20"):
        pages.filter(batch).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            append_facts(stream_pages(spark, source), table, checkpoint).awaitTermination()
    facts = spark.read.parquet(table)
    assert facts.count() == pages.count()
    _same_outputs(facts, pages)


def test_stream_takes_late_files_in_small_batches(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    pages = read_pages(spark, f"{SF}/pages.parquet")
    for batch in ("page_id < 20", "page_id >= 20"):
        known = set(glob.glob(f"{source}/*.parquet"))
        pages.filter(batch).coalesce(1).write.mode("append").parquet(source)
        if known:  # the later file is dated 30 days before the first
            (late,) = set(glob.glob(f"{source}/*.parquet")) - known
            past = os.path.getmtime(next(iter(known))) - 30 * 86_400
            os.utime(late, (past, past))
        append_facts(stream_pages(spark, source, 1), table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == pages.count()


def test_no_query_keeps_part_of_a_table(spark):
    """Every page and every part is in the outputs that have one row per page."""
    for name, table in (("page_metadata", "pages"), ("page_text", "pages"),
                        ("rendered_metadata", "part"), ("rendered_text", "part")):
        assert contract.queries()[name](spark, SF).count() == (
            spark.read.parquet(f"{SF}/{table}.parquet").count()
        )
