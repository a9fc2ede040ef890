"""Column functions over codes, names and expressions. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import SENTINELS

#: Six or seven digits: longer descriptors don't match; give another pattern to take them.
CODE = r"^(?:MESH:)?(D\d{6,7}|C\d{6,7})$"


def normalise_code(code: Column, pattern: str = CODE) -> Column:
    """The trimmed code without its prefix, or null if it is a sentinel or not of the pattern."""
    code = F.trim(code)
    return F.when(~code.isin(*SENTINELS), F.nullif(F.regexp_extract(code, pattern, 1), F.lit("")))


def split_composite(codes: Column, separators: str = r"[,;|]") -> Column:
    """The parts of a composite code, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(codes, separators), lambda x: F.trim(x)), lambda x: x != "")


def strip_prefix(code: Column, prefix: str = "MESH:", any_case: bool = False) -> Column:
    if any_case:
        return F.trim(F.regexp_replace(code, f"(?i)^{prefix}", ""))
    return F.when(F.startswith(code, F.lit(prefix)), F.substring(code, len(prefix) + 1, 1 << 30)).otherwise(code)


def role_code(role: Column) -> Column:
    """The part after the first bar, or all of it."""
    return F.trim(F.substr(role, F.instr(role, F.lit("|")) + 1))


def strip_suffix(term: Column) -> Column:
    """A name without its last group in brackets."""
    return F.trim(F.regexp_replace(term, r"\s*\([^)]+\)\s*$", ""))


def expression_tokens(expression: Column) -> Column:
    """array<struct<op, id, term>> of the concepts in a constraint expression, excluded ones included."""
    pattern = F.lit(r"(<<|<=|<|>>|>=|>|=)?\s*(\d{6,18})(?:\s*\|([^|]*)\|)?")
    part = lambda i: F.regexp_extract_all(expression, pattern, F.lit(i))
    rows = F.arrays_zip(part(1).alias("op"), part(2).alias("id"), part(3).alias("term"))
    return F.transform(rows, lambda r: F.struct(F.when(r["op"] == "", "=").otherwise(r["op"]).alias("op"), r["id"].alias("id"), F.trim(r["term"]).alias("term")))


def expression_roots(expression: Column) -> Column:
    """The distinct ids of an expression, in order of first appearance."""
    return F.array_distinct(F.transform(expression_tokens(expression), lambda r: r["id"]))


def decode(code: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    """A code's name; an unknown code passes through, or gives the default."""
    out = F
    for key, name in names.items():
        out = out.when(code == key, F.lit(name))
    return out.otherwise(code if default is None else default)


def join_text(title: Column, abstract: Column) -> Column:
    return F.when(F.coalesce(abstract, F.lit("")) == "", F.coalesce(title, F.lit(""))).otherwise(F.concat_ws(" ", F.coalesce(title, F.lit("")), abstract))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def to_flag(column: Column) -> Column:
    """1/0, true/false, t/f to boolean; anything else raises."""
    low = F.lower(F.trim(column))
    return F.when(low.isin("1", "true", "t"), F.lit(True)).when(low.isin("0", "false", "f"), F.lit(False)).when(column.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), column)).cast("boolean"))


def to_day(column: Column) -> Column:
    """YYYYMMDD to a date; an invalid one raises in ANSI mode."""
    return F.to_date(blank_to_null(column), "yyyyMMdd")


def mesh_identifiers(raw: Column) -> Column:
    """struct<raw, single, ids>: the bar-separated parts of a field that is one code or more, single if there is one only."""
    clean = F.trim(raw)
    parts = F.filter(F.transform(F.split(clean, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    ids = F.when(normalise_code(clean).isNull(), F.array().cast("array<string>")).otherwise(parts)
    return F.when(raw.isNotNull(), F.struct(clean.alias("raw"), F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).alias("single"), ids.alias("ids")))


def listed_identifiers(raw: Column) -> Column:
    """struct<raw, normalised, ids>: the comma-separated parts of a field and the first of them."""
    clean = F.trim(raw)
    ids = F.filter(F.transform(F.split(clean, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(raw.isNotNull(), F.struct(clean.alias("raw"), F.try_element_at(ids, F.lit(1)).alias("normalised"), ids.alias("ids")))


def copy_field(column: Column, kind: str) -> Column:
    """A value in the text form of a bulk load: backslash-N for null, t or f, arrays in braces, tabs and line ends escaped."""
    if kind == "boolean":
        text = F.when(column, "t").otherwise("f")
    elif kind.startswith("array"):
        quoted = F.transform(column, lambda x: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
        text = F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))
    else:
        text = column.cast("string")
        for char, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(char), F.lit(escaped))
    return F.when(column.isNull(), "\\N").otherwise(text)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage, 0 of an empty whole, rounded half-even."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * part / whole, digits))


def softmax(values: Column, temperature: float) -> Column:
    """Softmax of an array<double>, shifted by its maximum."""
    powers = F.transform(values, lambda x: F.exp((x - F.array_max(values)) / F.lit(temperature)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    """The product of two number arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A number array in double precision, of length 1; a zero array is null."""
    length = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return F.when(length.isNotNull(), F.transform(a, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def anneal(epoch: Column, epochs: int, start: float, end: float) -> Column:
    """Linear from start in the first epoch to end in the last."""
    return F.lit(start) + (F.lit(end) - F.lit(start)) * epoch / F.lit(max(epochs - 1, 1))


def padded(column: Column, size: int, fill: Column) -> Column:
    """An array cut or filled to a size."""
    return F.slice(F.concat(column, F.array_repeat(fill, size)), 1, size)


def hop_similarity(hops: Column) -> Column:
    return F.lit(1.0) / (F.lit(1) + hops)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row: inside an array function a column expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_ngrams(text: Column, size: int = 3, dims: int = 64) -> Column:
    """A text's character n-grams as an array<double> of hashed counts: a fixed stand-in for a term encoder.

    The hash is a polynomial of the code points, the same in every engine.
    """
    low = F.lower(F.concat(F.lit(" "), text, F.lit(" ")))
    codes = F.transform(F.split(low, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h * 1_000_003 + c) % 2_147_483_647
    places = lambda codes: F.sequence(F.lit(1), F.greatest(F.size(codes) - size + 1, F.lit(1)))
    grams = lambda codes: F.transform(places(codes), lambda i: F.aggregate(F.slice(codes, i, F.lit(size)), F.lit(0).cast("long"), step) % dims)
    counts = lambda grams: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("double"))
    return let(codes, lambda codes: let(grams(codes), counts))
