import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from landgraph.llm import warc as A

SCHEMA = "page_id long, url string, html string, payload string, path string"


def some_pages():
    r = random.Random(1)
    big = ["é" * 700, "x" * 1000, "y" * 999, "".join(chr(r.randrange(32, 0x3000)) for _ in range(90_000))]
    rows = [(i, f"http://h.org/{i}", r.choice([*big, None, "", "short", f"own {i} " * 300]), "clash", None) for i in range(300)]
    return rows + [(1000, None, None, "", ""), (1001, "http://ä b\r\nX: y/\x00", big[3], "", ""), (1001, "again", big[3], "", ""), (None, "no id", big[1], "", ""), (1002, "http://h.org/" + "long" * 60_000, "own", "", ""), (1003, "http://h.org/é\r\n\r\n" * 9_000, big[1], "", "")]


def test_round_trip(spark):
    rows = some_pages()
    archives = A.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), file_bytes=100_000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) and archives.count() > 3
    top = defaultdict(int)
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top[h], i)
    want = sorted((str(i), "revisit" if i is not None and h in top and i < top[h] else "response", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), str(top[h]) if i is not None and h in top and i < top[h] else "None") for i, _, h, *_ in rows)
    for split in (777, 50_000, 1 << 30):
        got = A.read_archives(archives, split).collect()
        assert sorted((str(x.page_id), x.record_type, x.declared_bytes, x.declared_digest, str(x.refers_to)) for x in got) == want
        assert len({(x.path, x.offset) for x in got}) == len(rows)
        assert all((x.payload is None) == (x.record_type == "revisit") and (x.payload is None or hashlib.sha1(x.payload).hexdigest() == x.declared_digest) for x in got)


def test_query_and_sql_agree(spark, tmp_path):
    import duckdb

    spark.createDataFrame([x for x in some_pages() if x[0] is not None and x[1] != "again"], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = A.op8_warc_archives(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(A.OP8_SQL).fetchall()))


class _Bytes:
    def __init__(self, data):
        self.data, self.place = data, 0

    def seek(self, n):
        self.place = n

    def read(self, n):
        return self.data[self.place : self.place + n]


def test_false_magic_and_damage():
    one = A.record(1, "http://a/", b"x" * 5000, b"0" * 20, None, "d")
    other = zlib.compressobj(4, zlib.DEFLATED, 31)
    stray = other.compress(b"not an archive") + other.flush()
    data = b"junk" + A.MAGIC + b"\x00\x00" + stray + one + A.MAGIC + one
    for cut in range(0, len(data), 13):
        source = A._Source(_Bytes(data), len(data))
        found = [o for a, b in ((0, cut), (cut, len(data))) for o, _ in A.records_of(source, a, b)]
        assert found == [data.index(one), data.rindex(one)]
    with pytest.raises(ValueError):
        list(A.records_of(A._Source(_Bytes(one[:-9]), len(one) - 9), 0, 99))


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert A.read_archives(A.write_archives(frame)).collect() == []
    with pytest.raises(ValueError):
        A.write_archives(frame.drop("url"))
