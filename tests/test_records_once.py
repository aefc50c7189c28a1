"""Sealed records: modular powers by OpenSSL equal Python's, and a table that is kept is computed once."""

import random

from pyspark.sql import functions as F

from cloakwork.operators import records
from cloakwork.operators.records import Records


def test_powers():
    rng, p = random.Random(3), records.prime()
    pairs = [(2, 1), (1, 5), (p - 1, p - 1), *((rng.randrange(2, p), rng.getrandbits(256) | 1) for _ in range(20))]
    assert records._openssl() is not None
    assert all(records.power(a, e) == records._openssl()(a, e) == pow(a, e, p) for a, e in pairs)
    assert records.power(0, 5) == 0 and records.power(p + 2, 3) == 8 and records.power(5, 0) == 1


def test_computed_once(spark):
    Records(spark)
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    once = records.kept(spark.range(100).repartition(4).select(F.udf(seen, "long")("id").alias("x")))
    assert once.agg(F.sum("x")).first()[0] == 4950 and calls.value == 100
