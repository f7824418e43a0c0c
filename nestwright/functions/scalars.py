"""Scalar column functions. All are built-in expressions, so they stay inside whole-stage code generation.

Only user callables need Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as text trimming sees it (Spark's trim knows only the blank).
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: What an identifier may hold unescaped, and what marks a path traversal.
SAFE = "A-Za-z0-9._~:@!$&'()*+,;=-"
TRAVERSAL = r"\.\.[/\\]|[/\\]\.\.|^\.\.|\.\.%|%2[eE]%2[eE]"
#: Personal data in running text, and names of fields that hold it.
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PRIVATE_FIELDS = frozenset({
    "ssn",
    "social_security_number",
    "date_of_birth",
    "dob",
    "birthdate",
    "person_identifier",
    "personidentifier",
    "personidentifiers",
    "first_name",
    "firstname",
    "last_name",
    "lastname",
    "lastorsurname",
    "middle_name",
    "middlename",
    "generationcodeorsuffix",
})
REDACTED = "***REDACTED***"
_FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once however often it is used; inside lambdas Spark would repeat it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends; the first and last character tell whether there is any."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(SPACE), F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    """Null or only white space."""
    return c.isNull() | ~c.rlike("[^" + SPACE[1:])


def is_missing(c: Column, kind: T.DataType, collections: bool = True) -> Column:
    """Null, blank, NaN or (for mapping, not for validation) an empty collection."""
    if isinstance(kind, T.StringType):
        return is_blank(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, (T.ArrayType, T.MapType)) and collections:
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def scalar_error(c: Column, kind: T.DataType, source: str, prop: str) -> Column | None:
    """Why a value that is there cannot be a scalar: nested types and booleans never, doubles when infinite."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(f"Field '{source}' in property '{prop}' holds a nested value; flatten it first")
    if isinstance(kind, T.BooleanType):
        return F.lit(f"Field '{source}' in property '{prop}' holds a boolean; convert it to text first")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(c) == float("inf"), F.lit(f"Field '{source}' in property '{prop}' is infinite"))
    return None


def strip_control(c: Column) -> Column:
    """Without C0 and C1 control characters and DEL; tab, line feed and carriage return stay."""
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
    return F.when(c.rlike(control), F.regexp_replace(c, control, "")).otherwise(c)


def prefixed(prefix: str, drop_blanks: bool = False) -> Callable[[Column], Column]:
    """Prefix and trimmed value; null when blank. With ``drop_blanks`` inner blanks go too."""

    def apply(c: Column) -> Column:
        text = F.replace(strip(c), F.lit(" "), F.lit("")) if drop_blanks else strip(c)
        return F.when(text != "", F.concat(F.lit(prefix), text))

    return apply


def int_clean(c: Column) -> Column:
    """Whole numbers in canonical form (any length), other finite numbers cut toward zero, anything else trimmed."""
    return let(strip(c), _int_clean)


def _int_clean(text: Column) -> Column:
    number = text.try_cast("double")
    whole = F.regexp_replace(F.regexp_replace(text, "^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
    cut = F.when(F.abs(number) < 9e18, number.try_cast("bigint").cast("string")).when(F.abs(number) < 1e38, number.try_cast("decimal(38,0)").cast("string")).otherwise(text)
    return F.when(text.rlike("^-?[0-9]+$"), whole).when(text.rlike(_FLOAT), cut).otherwise(text)


def first_segment(c: Column) -> Column:
    """First ``|`` segment, trimmed and cleaned as a number; null when blank."""
    first = strip(F.split_part(c, F.lit("|"), F.lit(1)))
    return F.when(first != "", int_clean(first))


def date_iso(c: Column) -> Column:
    """The date of an ISO-like date or timestamp, zero-padded; null when it is none."""
    form = r"(?s)^0*([0-9]{1,4})-0*([0-9]{1,2})-0*([0-9]{1,2})(?:T.*| [^T]*)?$"
    padded = r"(?s)^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T.*| [^T]*)?$"
    text = strip(c)
    day = F.when(text.rlike(form), F.regexp_replace(text, form, "$1-$2-$3"))
    any_form = let(day, lambda d: F.when(~d.startswith("0-"), F.date_format(F.try_to_date(d, "y-M-d"), "yyyy-MM-dd")))
    return F.when(c.rlike(padded), F.substring(c, 1, 10).try_cast("date").cast("string")).otherwise(any_form)


def decimal_clean(c: Column) -> Column:
    """A decimal number without blanks around it; null when it is none (an extension)."""
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text)


@dataclass(frozen=True)
class Transform:
    """A named value function; ``fails(text, value)`` says for which non-null texts it is an error, as a message column."""

    apply: Callable[[Column], Column]
    fails: Callable[[Column, Column], Column] | None = None


TRANSFORMS: dict[str, Transform] = {
    "sex_prefix": Transform(prefixed("Sex_")),
    "race_prefix": Transform(prefixed("RaceAndEthnicity_", drop_blanks=True)),
    "first_pipe_split": Transform(first_segment),
    "int_clean": Transform(int_clean),
    "date_format": Transform(date_iso, lambda c, v: F.when(c.isNotNull() & v.isNull(), F.concat(F.lit("Value '"), c, F.lit("' is not a calendar date YYYY-MM-DD")))),
    "decimal_clean": Transform(decimal_clean),
    "strip_whitespace": Transform(lambda c: F.when(strip(c) != "", strip(c))),
}


def python_transform(function: Callable[[str], object]) -> Transform:
    """A plain Python callable as a transform, in Arrow batches. Text and numbers become text; other results are errors."""
    @F.pandas_udf("value string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                r = None if v is None else function(v)
                bad = isinstance(r, (bool, dict, list, tuple, set))
                out.append((None, f"returned {type(r).__name__}") if bad else (None if r is None else str(r), None))
            except Exception as e:
                out.append((None, f"raised {type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return Transform(lambda c: run(c)["value"], lambda c, _: run(c)["error"])


def _escape(c: Column, safe: str) -> Column:
    each = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(f"^[{safe}]$"), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")))
    return F.array_join(each, "")


def iri_component(c: Column, normalise: bool = True) -> Column:
    """Percent-encoded identifier part; null when blank. Values that climb paths lose even their dots."""
    text = strip(nfc(c) if normalise else c)
    safe = F.when(text.rlike(f"^[{SAFE}]+$"), text).otherwise(_escape(text, SAFE))
    return F.when(text == "", None).when(text.rlike(TRAVERSAL), _escape(text, "A-Za-z0-9_~-")).otherwise(safe)


def nfc(c: Column) -> Column:
    """Unicode NFC, inside the JVM: Spark ships the ICU library, and only non-ASCII values are passed to it."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def json_quote(c: Column) -> Column:
    """A JSON string; null stays null."""
    slow = F.to_json(F.array(c))
    return F.when(c.rlike(r'[\x00-\x1F"\\]'), F.substr(slow, F.lit(2), F.length(slow) - 2)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def mask_text(c: Column) -> Column:
    """Social security numbers and e-mail addresses in running text replaced."""
    return F.regexp_replace(F.regexp_replace(c, SSN, REDACTED), EMAIL, REDACTED)


def mask_column(name: str, c: Column, kind: T.DataType) -> Column:
    """Personal data out of a column of any nesting: named fields whole, texts by pattern."""
    if name.lower() in PRIVATE_FIELDS:
        return F.when(c.isNotNull(), F.lit(REDACTED))
    if isinstance(kind, T.StringType):
        return mask_text(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: mask_column("", x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(mask_column(f.name, c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return c


def formula_guard(c: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(F.regexp_replace(c, r"^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def document_key(c: Column, strict: bool = False) -> Column:
    """Identifier as a document-store key: ``/`` becomes ``|``. With ``strict`` an empty or null one is an error."""
    key = F.translate(c, "/", "|")
    return F.when(c.isNull() | (c == ""), F.raise_error(F.lit("an empty identifier is no document key")).cast("string")).otherwise(key) if strict else key


def local_name(c: Column) -> Column:
    """After the last ``#``, else after the last ``/``."""
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(F.substring_index(c, "/", -1))


def normal_name(c: Column) -> Column:
    """A column name for comparison: lower case without separators."""
    return F.lower(F.regexp_replace(c, r"[\s_\-./]+", ""))


def clamp01(c: Column) -> Column:
    """Into [0, 1]; NaN is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(c, F.lit(0.0))))
