"""Tables in which one user, one article or one order owns a third of all rows."""

import duckdb
import pytest

from check_queries import TABLES, difference, open_tables
from clickmill.plans import registry
from clickmill.plans.fixtures import LOG_START

SOURCE = "/root/testdata/sf0.001"
registry.load_all()

# Changes of one column of the source tables.
HOT_KEYS = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM orders",
    "lineitem": """SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey)
      FROM lineitem""",
}
# A third of the line items in one order of the log, a third in some user's first order.
HOT_ORDERS = {
    "lineitem": f"""SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0
        THEN (SELECT min(o_orderkey) FROM orders WHERE o_orderdate >= TIMESTAMP '{LOG_START}')
        WHEN l_suppkey % 3 = 1 THEN (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders
          WHERE o_orderdate < TIMESTAMP '{LOG_START}')
        ELSE l_orderkey END AS l_orderkey) FROM lineitem""",
}
CHECKED = [
    "rsh_1_interactions", "join_1_article_lookup", "agg_1_article_clicks", "agg_2_article_history",
    "agg_5_counts_per_impression", "agg_8_rating_lists", "agg_10_median_hour", "agg_12_user_by_item_cluster",
    "agg_13_user_cluster_by_item", "agg_14_index_sets", "win_1_first_history", "win_6_long_tail",
    "win_8_next_item_examples", "fea_2_user_features", "voc_2_frequency_vocabulary", "fm_1_design_matrix",
    "fac_1_gradient_step", "fac_2_least_squares_round", "dt_4_hourly_clicks", "rec_5_hybrid_top_n",
]


def tables(folder, changes):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SOURCE}/{name}.parquet'")
    for name in TABLES:
        text = changes.get(name, f"SELECT * FROM {name}")
        con.execute(f"COPY ({text}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("hot"), HOT_KEYS)


@pytest.fixture(scope="module")
def hot_orders_dir(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("orders"), HOT_ORDERS)


@pytest.fixture
def no_broadcast(spark):
    """Every join shuffles, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", CHECKED)
def test_hot_user_and_article(spark, hot_dir, no_broadcast, name):
    con = open_tables(hot_dir)
    df = registry.QUERIES[name](spark, hot_dir)
    assert difference(df, con, registry.ORACLES[name]) is None


@pytest.mark.parametrize("name", [
    "src_1_log_tsv", "flt_3_rows_with_history", "rsh_1_interactions", "agg_2_article_history", "agg_5_counts_per_impression",
    "win_1_first_history", "agg_8_rating_lists", "fea_2_user_features", "dt_4_hourly_clicks", "dt_3_rows_per_hour_edge",
])
def test_hot_orders(spark, hot_orders_dir, name):
    """A large log order and a large first order: every token of both is there."""
    con = open_tables(hot_orders_dir)
    df = registry.QUERIES[name](spark, hot_orders_dir)
    assert difference(df, con, registry.ORACLES[name]) is None
