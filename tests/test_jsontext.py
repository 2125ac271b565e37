"""JSON text as Python's json.dumps writes it."""

import json
import random
import struct

from huddle.functions.jsontext import dumps_entries, dumps_number, dumps_string


def test_numbers(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 12.0, 1e7, 9999999.0, 12345678.9, 1e-4, 9.9e-5, 1e-3, 1e15, 1e16, 123456789012345680.0, 9007199254740993.0, 5e-324, 1e-323,
              1.5e-323, 2e-323, 2.5e-322, 1.7976931348623157e308, 2.2250738585072014e-308, 1e22, 1e23, 0.1 + 0.2, 1 / 3, 2e-3, -1e-7, -1.5e300,
              float("inf"), float("-inf"), 100.0, 3e10, 1.25e9]
    values += [struct.unpack("d", r.randbytes(8))[0] for _ in range(3000)]
    values += [r.random() * 10.0 ** r.randint(-12, 20) for _ in range(2000)] + [float(r.randint(1, 9) * 10 ** r.randint(0, 22)) for _ in range(200)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {x.i: x.t for x in df.select("i", dumps_number("x").alias("t")).collect()}
    wrong = [(v, got[i]) for i, v in enumerate(values) if got[i] != json.dumps(v)]
    assert not wrong, wrong[:5]
    assert spark.range(1).selectExpr("cast(null as double) as x").select(dumps_number("x").alias("t")).first().t == "null"


def test_strings(spark):
    texts = ["", "plain ~!", 'q"uote', "back\\slash", "tab\tnew\nret\rbs\bff\f", "".join(map(chr, range(0, 160))), "Łódź ß", "日本", "😀 and 𝒳", " ﻿￿", "a" * 5000 + '"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {x.i: x.j for x in df.select("i", dumps_string("t").alias("j")).collect()}
    assert got == {**{i: json.dumps(t) for i, t in enumerate(texts)}, 99: "null"}


def test_objects(spark):
    entries = [("a", 1.5), ('b"é', 1e16), ("c\n", 1e-5)]
    df = spark.createDataFrame([(entries,), ([],), (None,)], "e array<struct<id:string,score:double>>")
    assert [r.j for r in df.select(dumps_entries("e").alias("j")).collect()] == [json.dumps(dict(entries)), "{}", "{}"]
