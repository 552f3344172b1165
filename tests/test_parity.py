"""Registered queries next to their SQL at the smallest scale.

A few of each group run by default; ``SNAPCAT_ALL=1`` runs every one, and
``python tests/parity.py 0.01`` does so at any scale.
"""

import os

import parity
import pytest

from snapcat.registry import all_oracles, all_queries

DEFAULT = """
cat_tables cat_columns cat_constraints cat_foreign_keys cat_enums cat_types cat_routines view_dependencies
fk_incoming fk_counts fk_cardinality fk_scc junction_tables table_tags db_domains db_index start_tables table_buckets
column_semantics safe_name
profile_lineitem profile_nulls_events top_values_events enum_like_orders key_check_lineitem_line fk_check_orders_in_lineitem
check_eval_lineitem key_density_lineitem infer_fk_orders_customer
toon_quote toon_number toon_key toon_rows_part toon_table doc_columns doc_enums doc_domains docs_text
given_cat_foreign_keys given_cat_indexes given_cat_enums given_fk_cardinality given_fk_scc given_db_index
""".split()
NAMES = list(all_queries()) if os.environ.get("SNAPCAT_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con(sf_dir):
    return parity.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert parity.compare(spark, con, sf_dir, all_queries()[name], all_oracles()[name]) == ""


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 750
