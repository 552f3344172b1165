"""TOON text from columns: scalars, keys, objects and lists, all native expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that need quotes, keys that need none, indent width.
# ``\z`` is the end of the text; ``$`` would also match before a final line break.
NEEDS_QUOTES = r'^\z|^(true|false|null)\z|^[-0-9 ]| \z|[:"\\\[\]{},\x00-\x1f]'
BARE_KEY = r"^[A-Za-z_][A-Za-z0-9_.]*\z"
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
INDENT = "  "
NULL = "null"


def escaped(text: Column) -> Column:
    """Backslash first, so that the later escapes are not escaped again."""
    for char, replacement in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(replacement))
    return text


def needs_quotes(text: Column) -> Column:
    return text.rlike(NEEDS_QUOTES)


def quoted(text: Column) -> Column:
    return F.when(needs_quotes(text), F.concat(F.lit('"'), escaped(text), F.lit('"'))).otherwise(text)


def key_text(name: Column) -> Column:
    return F.when(name.rlike(BARE_KEY), name).otherwise(quoted(name))


def number_text(x: Column) -> Column:
    """Plain decimal form of a double: no exponent, no trailing zeros.

    Whole numbers go through bigint; short texts without an exponent are the
    plain form already. The rest is spelled out far enough for the smallest
    double and stripped. NaN and infinities have no JSON form and become null.
    Digits are the JVM's: before Java 19 a few doubles beyond 1e18 show one
    digit more than the shortest form that reads back the same.
    """
    x = x.cast("double")
    shown = x.cast("string")
    spelled = F.rtrim(F.rtrim(F.format_string("%.345f", x), F.lit("0")), F.lit("."))
    return (
        F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), NULL)
        .when((x == F.floor(x)) & (F.abs(x) < 9.2e18), x.try_cast("bigint").cast("string"))
        .when(~shown.contains("E"), shown)
        .otherwise(spelled)
    )


def float_text(x: Column) -> Column:
    """As number_text for a float: the digits are those of the float, not of the double next to it."""
    return number_text(x.cast("float").cast("string").cast("double"))


def decimal_text(x: Column, scale: int) -> Column:
    """Plain form of an exact decimal, without trailing zeros."""
    text = F.replace(F.format_number(x, scale), F.lit(","), F.lit(""))
    return F.when(x.isNotNull(), F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if scale else text)


def scalar_text(value: Column, kind: str) -> Column:
    """Text of a column of the given kind: string, bool, integer, double, float or decimal:SCALE."""
    if kind == "string":
        text = quoted(value)
    elif kind == "double":
        text = number_text(value)
    elif kind == "float":
        text = float_text(value)
    elif kind.startswith("decimal:"):
        text = decimal_text(value, int(kind.removeprefix("decimal:")))
    elif kind in ("bool", "integer"):
        text = value.cast("string")
    else:
        raise ValueError(f"no text form for {kind}")
    return F.coalesce(text, F.lit(NULL))


def kind_of(data_type: T.DataType) -> str:
    """Text kind of a Spark type; timestamps and dates are strings."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.DecimalType):
        return f"decimal:{data_type.scale}"
    if isinstance(data_type, T.FloatType):
        return "float"
    if isinstance(data_type, T.DoubleType):
        return "double"
    if isinstance(data_type, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "string"
    raise ValueError(f"no text form for {data_type.simpleString()}")


def inline_list(values: Column, kind: str = "string") -> Column:
    """``[N]: a,b``; ``[0]:`` when empty."""
    return texts_list(F.transform(values, lambda v: scalar_text(v, kind)))


@dataclass(frozen=True)
class Field:
    """A named member of an object.

    ``kind`` is string, bool, integer, double, raw (in text form already), strings
    (a list of strings) or raws (a list in text form); ``omit`` names when the member is left out: never, null, empty or false.
    ``source`` is the column it reads, the name itself by default.
    """

    name: str
    kind: str = "string"
    omit: str = "never"
    source: str | None = None

    @property
    def is_list(self) -> bool:
        return self.kind in ("strings", "raws")

    def present(self, item: Column) -> Column:
        value = item[self.source or self.name]
        if self.omit == "never":
            return F.lit(True)
        if self.omit == "null":
            return value.isNotNull()
        if self.omit == "false":
            return F.coalesce(value, F.lit(False))
        filled = F.size(value) > 0 if self.is_list else value != ""
        return F.coalesce(filled, F.lit(False))

    def text(self, item: Column) -> Column:
        value = item[self.source or self.name]
        if self.is_list:
            items = F.coalesce(value, F.array().cast("array<string>"))
            return inline_list(items) if self.kind == "strings" else texts_list(items)
        if self.kind == "raw":
            return F.coalesce(value, F.lit(NULL))
        return scalar_text(value, self.kind)

    def line(self, item: Column) -> Column:
        """``name: value``; a list follows the colon without a space."""
        gap = ":" if self.is_list else ": "
        return F.when(self.present(item), F.concat(F.lit(self.name + gap), self.text(item)))


def lines(parts: Sequence[Column], indent: int = 0) -> Column:
    """Present parts (NULL ones vanish), one per line."""
    pad = F.lit(INDENT * indent)
    return F.concat_ws("\n", *(F.concat(pad, part) for part in parts)) if indent else F.concat_ws("\n", *parts)


def object_lines(item: Column, fields: Sequence[Field], indent: int = 0) -> Column:
    return lines([field.line(item) for field in fields], indent)


def nested_object(name: str, body: Column, indent: int = 0) -> Column:
    """``name:`` with its lines below; ``body`` is already indented, '' means no member."""
    head = F.lit(f"{INDENT * indent}{name}:")
    return F.when(body == "", F.concat(head, F.lit(" {}"))).otherwise(F.concat(head, F.lit("\n"), body))


def presence(item: Column, fields: Sequence[Field]) -> Column:
    """Bit per member that is present."""
    mask = F.lit(0)
    for bit, field in enumerate(fields):
        if field.omit == "never":
            mask = mask + F.lit(1 << bit)
        else:
            mask = mask + F.when(field.present(item), 1 << bit).otherwise(0)
    return mask


def holds_list(item: Column, fields: Sequence[Field]) -> Column:
    """Whether a list member is present, which rules the table form out."""
    found = F.lit(False)
    for field in fields:
        if field.is_list:
            found = found | field.present(item)
    return found


def table_head(count: Column, mask: Column, fields: Sequence[Field]) -> Column:
    names = F.concat_ws(",", *(F.when(mask.bitwiseAND(1 << bit) > 0, f.name) for bit, f in enumerate(fields)))
    return F.concat(F.lit("["), count.cast("string"), F.lit("]{"), names, F.lit("}:"))


def table_row(item: Column, fields: Sequence[Field]) -> Column:
    """Comma row of the present members."""
    return F.concat_ws(",", *(F.when(f.present(item), f.text(item)) for f in fields if not f.is_list))


def dash_item(item: Column, fields: Sequence[Field], indent: int) -> Column:
    """``- `` and the members one level deeper; ``- {}`` without any."""
    body = object_lines(item, fields, indent + 1)
    start = F.lit(INDENT * indent + "- ")
    return F.when(body == "", F.concat(start, F.lit("{}"))).otherwise(F.concat(start, F.lit("\n"), body))


def with_texts(frame: DataFrame, fields: Sequence[Field], *keep: str) -> DataFrame:
    """One text column per member (NULL when left out) next to the columns to keep.

    The forms below use each text several times. Computing the texts in a
    projection of their own keeps the generated code small and runs the quoting
    once per value.
    """
    item = Members()
    return frame.select(*keep, *(F.when(f.present(item), f.text(item)).alias(f"text_{i}") for i, f in enumerate(fields)))


def shape_columns(fields: Sequence[Field], indent: int) -> list[Column]:
    """Presence mask, list flag, comma row and dash item out of the text columns."""
    texts = [F.col(f"text_{i}") for i in range(len(fields))]
    mask, nested = F.lit(0), F.lit(False)
    for bit, (field, text) in enumerate(zip(fields, texts, strict=True)):
        mask = mask + F.when(text.isNotNull(), 1 << bit).otherwise(0)
        if field.is_list:
            nested = nested | text.isNotNull()
    row = F.concat_ws(",", *(t for f, t in zip(fields, texts, strict=True) if not f.is_list))
    pad = INDENT * (indent + 1)
    members = F.concat_ws(
        "", *(F.concat(F.lit(f"\n{pad}{f.name}{':' if f.is_list else ': '}"), t) for f, t in zip(fields, texts, strict=True))
    )
    dash = F.concat(F.lit(INDENT * indent + "- "), F.when(mask == 0, "{}").otherwise(members))
    return [mask.alias("mask"), nested.alias("nested"), row.alias("row_text"), dash.alias("dash_text")]


class Members:
    """Members of an object that are columns of a frame."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def is_tabular(low: Column, high: Column, nested: Column) -> Column:
    """Table form: every object has the same members, at least one, none a list."""
    return (low == high) & (low > 0) & ~nested


def list_head(name: Column, count: Column, tabular: Column, mask: Column, fields: Sequence[Field]) -> Column:
    plain = F.concat(F.lit("["), count.cast("string"), F.lit("]:"))
    return F.concat(name, F.lit(":"), F.when(tabular, table_head(count, mask, fields)).otherwise(plain))


def list_text(name: str, items: Column, fields: Sequence[Field]) -> Column:
    """A list of objects held in one array of bounded length."""
    masks = F.transform(items, lambda item: presence(item, fields))
    nested = F.exists(items, lambda item: holds_list(item, fields))
    low = F.array_min(masks)
    tabular = F.coalesce(is_tabular(low, F.array_max(masks), nested), F.lit(False))
    rows = F.transform(items, lambda item: F.concat(F.lit("\n" + INDENT), table_row(item, fields)))
    dashes = F.transform(items, lambda item: F.concat(F.lit("\n"), dash_item(item, fields, 1)))
    body = F.array_join(F.when(tabular, rows).otherwise(dashes), "")
    return F.concat(list_head(F.lit(name), F.size(items), tabular, low, fields), body)


def texts_list(texts: Column) -> Column:
    """``[N]: a,b`` of items that are in text form already."""
    head = F.concat(F.lit("["), F.size(texts).cast("string"), F.lit("]:"))
    return F.when(F.size(texts) > 0, F.concat(head, F.lit(" "), F.array_join(texts, ","))).otherwise(head)
