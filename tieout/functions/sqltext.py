"""Writing rows out as SQL statement text. Nothing here runs the statements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieout.errors import RenderError
from tieout.functions.numeric import is_finite
from tieout.naming import col as _col

MAX_STATEMENTS = 5000
PLACEHOLDER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_ ]*)\}")


def _float_text(value: Column) -> Column:
    """Shortest text of a double without an exponent."""
    text = value.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    whole = F.regexp_replace(F.substring_index(mantissa, ".", 1), "-", "")
    part = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits, point = F.concat(whole, part), F.length(whole) + exponent
    sign = F.when(value < 0, "-").otherwise("")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.rpad(digits, point, "0")
    # 10^e with a mantissa shorter than e digits: whole number, otherwise the point moves inside.
    inside = F.concat(F.substring(digits, F.lit(1), point), F.lit("."),
                      F.substring(digits, point + 1, F.length(digits)))
    plain = F.when(point <= 0, small).when(F.length(digits) <= point, large).otherwise(inside)
    return F.when(text.contains("E"), F.concat(sign, plain)).otherwise(text)


def _moment(value: Column) -> Column:
    """A timestamp as text, with six decimals only where the second has a fraction; no zone involved."""
    text = value.cast("timestamp_ntz").cast("string")
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def sql_literal(value: Column, dtype: T.DataType) -> Column:
    """ANSI literal text of a column. Nested types are refused, non-finite numbers raise."""
    if isinstance(dtype, T.StringType):
        text = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    elif isinstance(dtype, T.BooleanType):
        text = F.when(value, "TRUE").otherwise("FALSE")
    elif isinstance(dtype, T.IntegralType):
        text = value.cast("string")
    elif isinstance(dtype, T.DecimalType):
        # The text of a decimal keeps its scale, trailing zeros included.
        text = value.cast("string")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        refuse = F.raise_error(F.lit("a non-finite number has no SQL literal")).cast("string")
        text = F.when(is_finite(value), _float_text(value)).otherwise(refuse)
    elif isinstance(dtype, T.DateType):
        text = F.concat(F.lit("DATE '"), value.cast("string"), F.lit("'"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("TIMESTAMP '"), _moment(value), F.lit("'"))
    elif dtype.typeName().startswith("time"):
        text = F.concat(F.lit("TIME '"), value.cast("string"), F.lit("'"))
    else:
        raise RenderError(f"{dtype.simpleString()} has no portable SQL literal")
    return F.when(value.isNull(), "NULL").otherwise(text)


def statement_text(df: DataFrame, template: str) -> Column:
    """The template with every ``{column}`` replaced by that column's literal."""
    types = {field.name: field.dataType for field in df.schema.fields}
    parts, position = [], 0
    for match in PLACEHOLDER.finditer(template):
        name = match.group(1)
        if name not in types:
            known = ", ".join(sorted(types)) or "(none)"
            raise RenderError(f"template names {{{name}}}, which is no column. There are: {known}")
        parts.append(F.lit(template[position:match.start()]))
        parts.append(sql_literal(_col(name), types[name]))
        position = match.end()
    return F.concat(*parts, F.lit(template[position:]))


def render_statements(df: DataFrame, template: str, limit: int | None = MAX_STATEMENTS) -> DataFrame:
    """One ``statement`` per row. More rows than ``limit`` are refused, never cut."""
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise RenderError(f"more than {limit:,} statements: too many for anyone to review")
    return df.select(statement_text(df, template).alias("statement"))


def script(statements: list[str], header: str | None = None, terminator: str = ";") -> str:
    """Reviewable script text of already collected statements."""
    if not statements:
        return ""
    comments = [f"-- {line}".rstrip() for line in (header or "").splitlines()]
    closed = [s.strip() if s.strip().endswith(terminator) else s.strip() + terminator
              for s in statements]
    return "\n".join(comments + closed)
