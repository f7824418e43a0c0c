import pytest
from pyspark.sql import functions as F

from nestwright.functions import scalars as S


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("x")).collect())]


CASES = [
    (S.int_clean, {"989897099.0": "989897099", "0": "0", "12345678901234567890": "12345678901234567890", "-007": "-7", "inf": "inf", "nan": "nan", "text": "text", "1e3": "1000", "-1.9": "-1", "12d": "12d", " 5 ": "5", None: None}),
    (S.first_segment, {"": None, "  ": None, "|12345": None, "111|222": "111", "1.0|2": "1", None: None}),
    (S.date_iso, {"2026-2-8": "2026-02-08", "2026-02-08T14:30:00": "2026-02-08", "2026-02-08 14:30": "2026-02-08", "2026-13-01": None, "2026-02-30": None, "02/08/2026": None, "yesterday": None, "0-1-1": None, "2026-02": None, None: None}),
    (S.prefixed("Sex_"), {" Female ": "Sex_Female", "": None, " ": None, None: None}),
    (S.prefixed("R_", True), {"Two or More": "R_TwoorMore", " ": None}),
    (S.strip_control, {"a\x00b\x07\t\n\r\x7f\x85c": "ab\t\n\rc", None: None}),
    (S.iri_component, {"a b": "a%20b", "<x>": "%3Cx%3E", "a/b": "a%2Fb", "../x": "%2E%2E%2Fx", "..\\x": "%2E%2E%5Cx", "a.b": "a.b", "é": "%C3%A9", "": None, None: None}),
    (S.formula_guard, {"=1": "'=1", "  +x": "'  +x", "a=b": "a=b", "-": "'-", None: None}),
    (S.mask_text, {"call 123-45-6789 or a.b@c.org": f"call {S.REDACTED} or {S.REDACTED}", "x": "x", None: None}),
    (S.local_name, {"http://a/b#c": "c", "http://a/b": "b"}),
    (S.normal_name, {"First_Name": "firstname", "a-b.c/d": "abcd"}),
    (S.strip, {"  a b\x1c\n": "a b", "": "", None: None}),
    (S.json_quote, {'a"b': '"a\\"b"', "x": '"x"', "\n": '"\\n"', None: None}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(spark, case):
    f, table = CASES[case]
    assert apply(spark, f, list(table)) == list(table.values())


def test_masking_reaches_nested_columns(spark):
    df = spark.sql("select named_struct('ssn', 'x', 'note', array('a@b.org', 'c')) as person")
    row = df.select(S.mask_column("person", F.col("person"), df.schema["person"].dataType).alias("p")).head().p
    assert row.ssn == S.REDACTED and row.note == [S.REDACTED, "c"]
