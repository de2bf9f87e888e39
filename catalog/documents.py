"""Capture documents that Spark derives from the given tables.

Each customer is one capture run whose bootstrap document lists the customer and a
second entity with gaps; each order is one per-entity document; each event is one
run manifest. All documents are built from single rows, turned to JSON text and
parsed again with the library's own schemas, so nothing is gathered to build them.

A narrow row becomes some kilobytes of text, so the size of a table's files says little
about the work in it: rows are dealt out by their number before documents are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import table
from tidemark.functions import scalars
from tidemark.sources import captures

# Documents that one task builds and parses: about half a second of bootstraps, which are
# the largest, and as much of the others.
BOOTSTRAPS_PER_TASK = 5_000
DOCUMENTS_PER_TASK = 40_000

BOOTSTRAP_URL = "https://example.com/bootstrap"
FIXTURES_URL = "https://example.com/fixtures"

_EVENTS = """transform(sequence(1, 12), i -> named_struct(
  'id', i,
  'deadline_time', if(c_custkey % 17 = 0, cast(null as string),
     format_string('%d-%02d-01T17:30:00Z',
       1995 + c_custkey % 6 + cast(floor((i + 6) / 12) as bigint), (i + 6) % 12 + 1)),
  'is_current', i = c_custkey % 13,
  'is_next', i = c_custkey % 13 + 1))"""

_ELEMENTS = """array(
  named_struct('id', c_custkey, 'code', c_custkey + 1000,
    'first_name', split_part(c_name, '#', 1), 'second_name', split_part(c_name, '#', 2),
    'element_type', cast(c_nationkey % 5 as bigint), 'team', cast(c_nationkey as bigint),
    'selected_by_percent', cast(c_custkey % 1000 as string),
    'now_cost', cast(floor(c_acctbal) as bigint),
    'transfers_in_event', c_custkey % 7, 'transfers_out_event', c_custkey % 11,
    'ep_next', cast(c_custkey % 9 as string), 'status', lower(substr(c_mktsegment, 1, 1)),
    'chance_of_playing_next_round', 25 * (c_custkey % 5), 'news', ''),
  named_struct('id', c_custkey + 10000000, 'code', c_custkey + 20000000,
    'first_name', 'Reserve', 'second_name', '',
    'element_type', cast(9 as bigint), 'team', cast(null as bigint),
    'selected_by_percent', cast(null as string), 'now_cost', cast(40 as bigint),
    'transfers_in_event', cast(null as bigint), 'transfers_out_event', cast(3 as bigint),
    'ep_next', '', 'status', cast(null as string),
    'chance_of_playing_next_round', cast(null as bigint), 'news', c_mktsegment))"""

_LABELS = """array(named_struct('id', cast(1 as bigint), 'singular_name_short', 'GKP'),
  named_struct('id', cast(2 as bigint), 'singular_name_short', 'DEF'),
  named_struct('id', cast(3 as bigint), 'singular_name_short', 'MID'),
  named_struct('id', cast(4 as bigint), 'singular_name_short', 'FWD'))"""


def _dealt(rows: DataFrame, key: str, per_task: int, at_most: int | None = None) -> DataFrame:
    """Rows of a table by their key, ``per_task`` to a task; file footers tell how many there are.
    Derived rows, which would have to be made to be counted, are dealt by a bound on their number."""
    number = rows.count() if at_most is None else at_most
    return rows.repartition(max(1, -(-number // per_task)), key)


def _parsed(bodies: DataFrame, schema: str) -> DataFrame:
    """JSON text to columns. The generator makes Spark parse each text once, however
    many of its fields are used further on."""
    keys = [c for c in bodies.columns if c != "body"]
    return bodies.select(*keys, F.inline(F.array(F.from_json("body", schema))))


def bootstrap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _dealt(table(spark, sf_dir, "customer"), "c_custkey", BOOTSTRAPS_PER_TASK)
    nation = table(spark, sf_dir, "nation")
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    body = named.selectExpr(
        "concat('c', c_custkey) as run",
        f"""to_json(named_struct('events', {_EVENTS}, 'elements', {_ELEMENTS},
          'element_types', {_LABELS},
          'teams', array(named_struct('id', cast(c_nationkey as bigint), 'name', n_name)),
          'total_players', 1000 + c_custkey)) as body""",
    )
    return _parsed(body, captures.BOOTSTRAP)


def summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order, with one completed period and one past season."""
    orders = _dealt(table(spark, sf_dir, "orders"), "o_orderkey", DOCUMENTS_PER_TASK)
    body = orders.selectExpr(
        "concat('c', o_custkey) as run",
        "o_custkey as element",
        """to_json(named_struct(
          'history', array(named_struct(
            'round', month(o_orderdate),
            'minutes', if(o_orderstatus = 'P', cast(null as int), day(o_orderdate) * 3),
            'total_points', cast(floor(o_totalprice / 1000) as bigint),
            'value', day(o_orderdate),
            'was_home', o_orderstatus = 'F',
            'kickoff_time', format_string('%s-%012d', date_format(o_orderdate, 'yyyy-MM-dd'),
                                          o_orderkey))),
          'history_past', array(named_struct(
            'season_name', concat(year(o_orderdate), '/', substr(year(o_orderdate) + 1, 3, 2)),
            'total_points', cast(floor(o_totalprice) as bigint))))) as body""",
    )
    return _parsed(body, captures.SUMMARY)


def yearly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer and year, holding that year's official total.

    There are no more of them than orders. A customer's orders are summed before they
    are dealt out, so that one with very many makes no large task.
    """
    orders = table(spark, sf_dir, "orders")
    totals = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.sum(F.floor("o_totalprice").cast("bigint")).alias("points")
    )
    dealt = _dealt(totals, "o_custkey", DOCUMENTS_PER_TASK, at_most=orders.count())
    body = dealt.selectExpr(
        "concat('c', o_custkey) as run",
        "o_custkey as element",
        """to_json(named_struct('history_past', array(named_struct(
          'season_name', concat(y, '/', substr(y + 1, 3, 2)), 'total_points', points)))) as body""",
    )
    return _parsed(body, captures.SUMMARY)


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per event; an error event lost its bootstrap, a click is unreadable."""
    events = _dealt(table(spark, sf_dir, "events"), "event_id", DOCUMENTS_PER_TASK)
    entries = f"""array(
      named_struct('url', '{BOOTSTRAP_URL}', 'status', if(event_type = 'error', 503, 200),
        'path', if(event_type = 'error', cast(null as string), 'bootstrap-static.json.gz'),
        'bytes', event_id),
      named_struct('url', '{FIXTURES_URL}', 'status', 200, 'path', 'fixtures.json.gz',
        'bytes', user_id),
      named_struct('url', '{BOOTSTRAP_URL}', 'status', 200, 'path', 'late.json.gz', 'bytes', 0L))"""
    body = events.select(
        F.concat(
            scalars.run_name(F.col("ts")), F.lit("."), F.col("event_id").cast("string")
        ).alias("run"),
        F.expr(
            f"""if(event_type = 'click', 'not a document', to_json(named_struct(
              'schema_version', 1,
              'gameweek', named_struct('current_event', cast(get_json_object(props, '$.k') as bigint)),
              'counts', named_struct('ok', if(event_type = 'error', 2, 3),
                                     'failed', if(event_type = 'error', 1, 0)),
              'entries', {entries})))"""
        ).alias("body"),
    )
    return _parsed(body, captures.MANIFEST)
