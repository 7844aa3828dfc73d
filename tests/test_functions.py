import pytest
from pyspark.sql import functions as F

from strandline.functions.keys import key_crc32, prefix_successor, valid_collection_name
from strandline.functions.numeric import format_f64, integer_of, parse_f64, parse_i64

FLOATS = ["+1", ".5", "5.", "1e5", "1e+5", "inf", "-inf", "+INFINITY", "nan", "+nan", "-NaN", "1e400", "-0", "0", "-5"]
NO_FLOATS = ["", " 1 ", "\t1", "1\n", "1d", "1.0f", "0x1p3", "1_0", ".", "1e", "+", "e5", "not-a-number", "١"]


def test_floats(spark):
    rows = spark.createDataFrame([(t,) for t in FLOATS + NO_FLOATS], "t string").select("t", parse_f64(F.col("t")).alias("x")).collect()
    got = {r["t"]: r["x"] for r in rows}
    assert all(got[t] is not None for t in FLOATS), got
    assert all(got[t] is None for t in NO_FLOATS), got
    assert got["+INFINITY"] == float("inf") and got["-inf"] == float("-inf") and got["+nan"] != got["+nan"] and got["5."] == 5.0


def test_integers(spark):
    texts = {"0": 0, "-5": -5, "+5": 5, "9223372036854775807": (1 << 63) - 1, "9223372036854775808": None, "1.5": None, " 1 ": None, "": None, "٣": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_i64(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == texts
    for text, value in texts.items():
        if value is None:
            with pytest.raises(ValueError):
                integer_of(text)
        else:
            assert integer_of(text) == value


@pytest.mark.parametrize("x,text", [(20.0, "20.0"), (1e7, "10000000.0"), (1e16, "1e16"), (1e15, "1000000000000000.0"), (1e-5, "1e-5"), (1.5e-7, "1.5e-7"), (0.0001, "0.0001"), (float("inf"), "inf"), (float("-inf"), "-inf"), (float("nan"), "NaN"), (-0.0, "-0.0"), (1.7e308, "1.7e308")])
def test_format(x, text):
    assert format_f64(x) == text


@pytest.mark.parametrize("prefix,after", [("cpu", "cpv"), ("", None), ("a\U0010ffff", "b"), ("퟿", ""), ("é", "ê"), ("\U0010ffff", None)])
def test_successor(prefix, after):
    assert prefix_successor(prefix) == after


def test_names_and_checksums(spark):
    assert valid_collection_name("a-B9") and not valid_collection_name("") and not valid_collection_name("a_b") and not valid_collection_name("a\n")
    assert spark.createDataFrame([("123456789",)], "k string").select(key_crc32(F.col("k"))).first()[0] == 0xCBF43926
