"""Text functions whose results follow Python's str, and offset converters. Offsets are code points everywhere else."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..session import bounded_batches

#: Python's white space as a Java class body: the Unicode property and the four separators it leaves out.
PY_SPACE = r"\s\x1c-\x1f"
#: White space to a tokenizer: also the C1 controls.
TOKEN_SPACE = r"\s\x1c-\x1f\x80-\x9f"


def bounded_udf(f, returns):
    """A function of Arrow arrays as an Arrow UDF that gets bounded batches."""

    def call(*columns: Column) -> Column:
        bounded_batches(SparkSession.active())
        return F.arrow_udf(f, returns)(*columns)

    return call


def arrow_str(f, returns: str, *types: str):
    """A per-value function of strings as an Arrow UDF; null in, null out."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()])

    return bounded_udf(run, returns)


def arrow_values(f, returns: str):
    """A per-value Python function as an Arrow UDF of one column of any type; null in, null out."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    held: list = []

    def run(values: pa.Array) -> pa.Array:
        # one value at a time: as Python objects nested rows take many times their Arrow bytes
        return pa.array((None if (v := x.as_py()) is None else f(v) for x in values), held[0])

    def call(c: Column) -> Column:
        # the type is parsed by the session, which is there by now
        if not held:
            held.append(to_arrow_type(_parse_datatype_string(returns)))
        typed = run
        typed.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return bounded_udf(typed, returns)(c)

    return call


def lower(c: Column) -> Column:
    """str.lower: full mappings (İ) and the final sigma."""
    return arrow_str(str.lower, "string")(c)


def is_upper(c: Column) -> Column:
    return arrow_str(str.isupper, "boolean")(c)


def is_lower(c: Column) -> Column:
    return arrow_str(str.islower, "boolean")(c)


def py_repr(c: Column) -> Column:
    return arrow_str(repr, "string")(c)


def lower_chars(word: str) -> str:
    """Each character in lower case by itself; one whose lower case is longer becomes U+FFFF."""
    return "".join(x if len(x := c.lower()) == 1 else "\uffff" for c in word)


def lower_chars_column(c: Column) -> Column:
    return arrow_str(lower_chars, "string")(c)


def collapse(c: Column) -> Column:
    """' '.join(text.split())"""
    return F.trim(F.regexp_replace(c, f"(?U)[{PY_SPACE}]+", " "))


def token_space(c: Column, skip_newline: bool = False) -> Column:
    """White space and C1 controls as single blanks; with skip_newline (Chinese) line breaks vanish first."""
    if skip_newline:
        c = F.replace(c, F.lit("\n"), F.lit(""))
    return F.regexp_replace(c, f"(?U)[{TOKEN_SPACE}]+", " ")


def simplify_punct(c: Column) -> Column:
    """Runs of question and exclamation marks become one: a question mark if they hold one."""
    runs = F.regexp_replace(c, r"[!?]*\?[!?]*(?<=..)", "?")
    return F.regexp_replace(runs, "!{2,}", "!")


def to_utf16(text: str, offset: int) -> int:
    return len(text[:offset].encode("utf-16-le", "surrogatepass")) // 2


def from_utf16(text: str, offset: int) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")[: 2 * offset].decode("utf-16-le", "replace"))


def _offsets(f):
    def run(texts: pa.Array, offsets: pa.Array) -> pa.Array:
        return pa.array([None if t is None or o is None else f(t, o) for t, o in zip(texts.to_pylist(), offsets.to_pylist(), strict=True)], pa.int32())

    return bounded_udf(run, IntegerType())


utf16_offset = _offsets(to_utf16)
code_point_offset = _offsets(from_utf16)
