"""Group H: scalar, key, object and list forms."""

import pytest
from pyspark.sql import functions as F

from snapcat.functions import toon
from snapcat.functions.names import safe_name
from snapcat.functions.toon import Field
from snapcat.operators.toon_rows import toon_rows


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("hello", "hello"), ("hello world", "hello world"), ("true", '"true"'), ("null", '"null"'), ("false", '"false"'), ("123", '"123"'),
    ("-5", '"-5"'), ("", '""'), (" a", '" a"'), ("a ", '"a "'), ("key:value", '"key:value"'), ("a\nb", '"a\\nb"'), ('say "x"', '"say \\"x\\""'),
    ("-flag", '"-flag"'), ("a,b", '"a,b"'), ("[x]", '"[x]"'), ("{x}", '"{x}"'), ("a\\b\t", '"a\\\\b\\t"'), ("a\x01", '"a\x01"'), ("ünï", "ünï"),
])
def test_quoting(spark, text, want):
    assert value(spark, toon.quoted(F.lit(text))) == want


@pytest.mark.parametrize(("number", "want"), [
    (0.0, "0"), (-0.0, "0"), (42.0, "42"), (3.14, "3.14"), (-0.5, "-0.5"), (1e-7, "0.0000001"), (1e22, "1" + "0" * 22),
    (12345678.9, "12345678.9"), (float("nan"), "null"), (float("inf"), "null"), (1 / 3, "0.3333333333333333"), (-1.25e-5, "-0.0000125"),
])
def test_numbers(spark, number, want):
    assert value(spark, toon.number_text(F.lit(number))) == want


def test_scalars(spark):
    assert value(spark, toon.scalar_text(F.lit(None).cast("string"), "string")) == "null"
    assert value(spark, toon.scalar_text(F.lit(True), "bool")) == "true"
    assert value(spark, toon.scalar_text(F.lit(9223372036854775807), "integer")) == "9223372036854775807"


@pytest.mark.parametrize(("key", "want"), [
    ("simple", "simple"), ("with_underscore", "with_underscore"), ("CamelCase", "CamelCase"), ("has space", "has space"),
    ("123numeric", '"123numeric"'), ("with:colon", '"with:colon"'), (" lead", '" lead"'), ("trail ", '"trail "'), ("a.b", "a.b"),
])
def test_keys(spark, key, want):
    assert value(spark, toon.key_text(F.lit(key))) == want


def test_inline_lists(spark):
    assert value(spark, toon.inline_list(F.array(F.lit("a"), F.lit("b,c")))) == '[2]: a,"b,c"'
    assert value(spark, toon.inline_list(F.array().cast("array<string>"))) == "[0]:"


PLAIN = (Field("a"), Field("b", "integer", "null"))


def listed(spark, rows, fields=PLAIN, schema="array<struct<a:string,b:int>>"):
    df = spark.createDataFrame([(rows,)], f"items {schema}")
    return df.select(toon.list_text("items", F.col("items"), fields)).first()[0]


def test_table_form(spark):
    assert listed(spark, [("x", 1), ("y z", 2)]) == "items:[2]{a,b}:\n  x,1\n  y z,2"
    assert listed(spark, [("x", None), ("y", None)]) == "items:[2]{a}:\n  x\n  y"


def test_mixed_form(spark):
    assert listed(spark, [("x", 1), ("y", None)]) == "items:[2]:\n  - \n    a: x\n    b: 1\n  - \n    a: y"
    assert listed(spark, []) == "items:[0]:"
    only = (Field("b", "integer", "null"),)
    assert listed(spark, [("x", None)], only) == "items:[1]:\n  - {}"


def test_list_members_rule_out_the_table_form(spark):
    fields = (Field("a"), Field("l", "strings"))
    text = listed(spark, [("x", ["p", "q"]), ("y", [])], fields, "array<struct<a:string,l:array<string>>>")
    assert text == "items:[2]:\n  - \n    a: x\n    l:[2]: p,q\n  - \n    a: y\n    l:[0]:"


def test_objects(spark):
    df = spark.createDataFrame([("v", None, True)], "a string, b int, c boolean")
    fields = (Field("a"), Field("b", "integer", "null"), Field("c", "bool", "false"))
    row = df.select(toon.object_lines(toon.Members(), fields), toon.nested_object("o", toon.object_lines(toon.Members(), fields, 1))).first()
    assert tuple(row) == ("a: v\nc: true", "o:\n  a: v\n  c: true")
    assert df.select(toon.nested_object("o", F.lit(""))).first()[0] == "o: {}"


def test_rows_in_chunks(spark):
    df = spark.createDataFrame([(i, f"n{i}", None if i == 3 else i / 2) for i in range(5)], "id bigint, name string, x double")
    docs = {r.chunk: r.doc for r in toon_rows(df, "id", 3).collect()}
    assert docs == {0: "[3]{id,name,x}:\n  0,n0,0\n  1,n1,0.5\n  2,n2,1", 1: "[2]{id,name,x}:\n  3,n3,null\n  4,n4,2"}


@pytest.mark.parametrize(("name", "want"), [
    ("Order  Details!", "order_details"), ("__x__", "x"), ("!!!", "unnamed"), ("", "unnamed"), ("a-b.c", "a_b_c"), ("Ünits", "nits"),
])
def test_safe_names(spark, name, want):
    assert value(spark, safe_name(F.lit(name))) == want
