"""The SQL that the registered queries are held against stays quick on one thread."""

import time

import parity
import pytest

from snapcat.registry import all_oracles

NAMES = "cat_row_estimate cat_constraints cat_indexes cat_foreign_keys cat_sequences cat_types doc_view_definition doc_relations".split()


@pytest.mark.parametrize("name", NAMES)
def test_seconds_on_one_thread(name):
    con = parity.connect("/root/testdata/sf0.01")
    con.execute("SET threads=1")
    start = time.time()
    assert con.execute(all_oracles()[name]).fetchall()
    assert time.time() - start < 20
