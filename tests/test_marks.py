"""Rules that are tried only where a text holds one of their marks give what all rules give."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import text as T

PIECES = (
    "authorization", "Authorization: Bearer a.b==", "AUTHORIZATION=basic zz", "cookie", "Set-Cookie: s=1; t", "eyJhb.eyJz.abc-d", "eyj", "rtmps://h/live2/k1", "RTMPS://x/Live2/", "api", "_key", "API-KEY=", "apikey: ", "token=", "Secret : ", "password='", "abcdefghij0123",
    "sk-proj", "SK", "ghp_", "xoxb-1234567890", "/home/joe/", "/Users//a b", "x.py", "C:\\Users\\joe\\", "c:\\users\\", "log.txt", "a@b.example.com", "@", "10.1.2.3", "256.1.1.1", ".", "user_id=", "ORDER_ID: ", "account_id", "_id=", "1234567", "123e4567-e89b-12d3-a456-426614174000",
    "-", "0xABCDEF01", "0x", "7", " ", "  ", "\t", "\n", "\r", "\x0b", "\f", "\u00a0", "\u2028", "İ", "\u212a", "ſ", "ß", "<", ">", "=", ":", "/", "'", ",",
)


@pytest.mark.parametrize("name", ["REDACTION", "TEMPLATE"])
def test_marks_lose_nothing(spark, name):
    rules, marks, r = getattr(T, f"{name}S"), getattr(T, f"{name}_MARKS"), random.Random(7)
    texts = [None, "", *PIECES, *["".join(r.choice(PIECES) for _ in range(r.randint(2, 12))) for _ in range(20_000)]]
    plain = F.col("t")
    for pattern, to in rules:
        plain = F.regexp_replace(plain, pattern, to)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plain.alias("want"), T.chain(F.col("t"), rules, marks).alias("got"))
    assert rows.where(~F.col("want").eqNullSafe(F.col("got"))).take(3) == []
    assert rows.where("want <> t").count() > 10_000


def test_a_rule_is_tried_only_where_its_mark_is(spark):
    rows = spark.createDataFrame([("Ab ab",), ("ab",)], "t string").select(T.chain(F.col("t"), (("(?i)ab", "x"), ("x", "y"), (" ", "_")), (("b a",), (), ())).alias("s")).collect()
    assert [x.s for x in rows] == ["y_y", "ab"]
