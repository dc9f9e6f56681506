from pyspark.sql import functions as F

from lodestone.functions.metadata import MetadataField, coerce_patch, metadata_map, reconstruct, rejected_keys, with_slots

FIELDS = [MetadataField(n, t, 1) for n, t in (("a", "str"), ("n", "num"), ("b", "bool"), ("d", "date"), ("t", "arr"))]
CASES = [
    ('{"a":1e3,"n":"2.5","b":"YES","d":"2024-01-02","t":["x","y"],"z":1}', ("1000", 2.5, True, 1704153600, ["x", "y"]), ["z"]),
    ('{"a":1.50,"n":true,"b":0,"d":1700000000.9,"t":["x",1]}', ("1.5", 1.0, False, 1700000000, None), ["t"]),
    ('{"a":true,"n":"zz","b":"maybe","d":"12/31/2023","t":[]}', ("true", None, None, 1703980800, []), ["b", "n"]),
    ('{"a":["x"],"n":3,"b":false,"d":"Mon, 02 Jan 2006 15:04:05 GMT","t":["x",null]}', (None, 3.0, False, 1136214245, None), ["a", "t"]),
    ('{"a":12345678901234567890}', ("12345678901234567000", None, None, None, None), []),
    ('{"a":1e-7}', ("0.0000001", None, None, None, None), []),
    ('{"a":null,"d":"2024-02-30"}', (None, None, None, None, None), ["a", "d"]),
    ("bad json", (None,) * 5, None),
    ("[1]", (None,) * 5, None),
    (None, (None,) * 5, None),
]


def test_routing(spark):
    df = spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(CASES)], "i int, j string")
    rows = with_slots(df, "j", FIELDS).select("i", *[F.col(f.column) for f in FIELDS], rejected_keys("j", FIELDS).alias("bad"))
    got = {r.i: (tuple(r[f.column] for f in FIELDS), r.bad) for r in rows.collect()}
    assert got == {i: (slots, bad) for i, (_, slots, bad) in enumerate(CASES)}


def test_patch_is_stricter(spark):
    df = spark.createDataFrame([('{"a":1,"n":"2","b":"yes","d":"2024-01-02","t":["x",1,"y"]}',)], "j string")
    members = metadata_map(F.col("j"))
    row = df.select(*[coerce_patch(members[f.name], f.type).alias(f.name) for f in FIELDS]).first()
    assert tuple(row) == (None, None, None, 1704153600, ["x", "y"])


def test_reconstruction(spark):
    df = with_slots(spark.createDataFrame([('{"a":"x","d":"2024-01-02"}',), (None,)], "j string"), "j", FIELDS)
    got = [r.m for r in df.select(reconstruct(FIELDS).alias("m")).collect()]
    assert got == ['{"a":"x","d":"2024-01-02T00:00:00Z"}', None]
