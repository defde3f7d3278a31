"""Very long texts must not exhaust the regex stack of an executor."""

from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions import text as X
from cloakwork.operators import detect as D
from cloakwork.operators import spans as SP
from cloakwork.sources import readers as S


def test_long_literals_values_and_lines(spark):
    rows = [('{"a":"' + "x\\n" * 100000 + '","n":1}', "K=" + "A1b2" * 10000 + " # c\nQ=\"" + "z" * 30000 + '"', "J o " * 5000,
             "-----BEGIN PRIVATE KEY-----" + "ab" * 3000 + "-----END PRIVATE KEY-----")]
    df = spark.createDataFrame(rows, "j string, e string, l string, p string")
    got = df.select(
        X.mask_json_strings(F.col("j")).alias("m"), F.transform(S.parse_dotenv(F.col("e")), lambda e: F.length(e.value)).alias("e"),
        F.size(SP.scan(F.col("l"), fixed.LETTER_SPACED)).alias("l"),
        F.transform(D.findings(F.col("p"), D.SECRET_RULES), lambda f: f.rule).alias("p"),
    ).first()
    assert got.m == '{"":"","":1}'
    assert list(got.e) == [40000, 30000]
    assert got.l == 1
    assert list(got.p) == ["private-key"]
