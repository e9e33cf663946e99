"""Networks, saved pages and frames."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources import networks, pages


def own_form(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return ip.packed.hex() if ip.version == 6 else "0" * 20 + "ffff" + ip.packed.hex()


ADDRESSES = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4", "", "::", "::1", "1::", "2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "g::", "12345::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "FE80::A", "::ffff:300.1.1.1", "name", ":1", "1:"]


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES] + [(None,)], "a string")
    got = {r.a: r.h for r in df.select("a", networks.hexadecimal(F.col("a")).alias("h")).collect()}
    assert got == {a: own_form(a) for a in ADDRESSES} | {None: None}


def test_longest_of_many_networks(spark):
    r = random.Random(7)
    nets = {f"10.{r.randrange(256)}.{r.randrange(256)}.0/{r.randrange(9, 25)}" for _ in range(300)} | {f"2001:db8:{r.randrange(1 << 16):x}::/{r.randrange(33, 49)}" for _ in range(300)} | {"10.0.0.0/8", "::/0", "192.168.1.7", "bad/8", "10.1.1.1/99", "fe80::/x"}
    known = {}
    for n in nets:
        try:
            net = ipaddress.ip_network(n, strict=False)
        except ValueError:
            continue
        bits = net.prefixlen + (96 if net.version == 4 else 0)
        known.setdefault((bits, int(own_form(str(net.network_address)), 16)), []).append(n)
    asked = [f"10.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}" for _ in range(300)] + [f"2001:db8:{r.randrange(1 << 16):x}::{r.randrange(1 << 16):x}" for _ in range(300)] + ["192.168.1.7", "8.8.8.8", "x", None]
    got = {x.address: (x.bits, x.network) for x in networks.longest(spark.createDataFrame([(a,) for a in asked], "address string"), spark.createDataFrame([(n,) for n in nets], "network string")).collect()}
    for a in asked:
        if a is None or not (form := own_form(a)):
            assert a not in got
            continue
        n = int(form, 16)
        bits = max(b for b, base in known if n >> (128 - b) == base >> (128 - b))
        assert got[a][0] == bits and got[a][1] in known[bits, n >> (128 - bits) << (128 - bits)]


def test_a_hundred_thousand_networks(spark):
    nets = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("10."), (F.col("id") / 512).cast("int"), F.lit("."), (F.col("id") / 2 % 256).cast("int"), F.lit(".0/24"))).otherwise(F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("id") % 65536)), F.lit(":"), F.lower(F.hex((F.col("id") / 65536).cast("long"))), F.lit("::/64"))).alias("network"))
    cases = [("10.0.5.9", "2001:db8::1", "2001:db8::1"), ("10.255.5.9", "1.2.3.4", "10.255.5.9"), ("2001:db8:5::77", " 9.9.9.9 , 10.0.0.1", "9.9.9.9"), ("::ffff:10.0.5.9", "fe80::1", "fe80::1"), ("2001:db9::1", "9.9.9.9", "2001:db9::1"), ("10.0.5.9", "not", "10.0.5.9"), ("10.0.5.9", None, "10.0.5.9"), (None, "9.9.9.9", None)]
    got = networks.clients(spark.createDataFrame(cases, "peer string, forwarded string, want string"), nets).collect()
    assert len(got) == len(cases) and all(r.client == r.want for r in got)
    assert networks.clients(spark.createDataFrame(cases, "peer string, forwarded string, want string"), nets.limit(0)).where("client <=> peer").count() == len(cases)


def test_saved_pages(spark, tmp_path):
    urls = [f"https://h{i % 4}.org/p/{i}?q=a b&x=ü" for i in range(20)] + ["http://h9.org/"]
    for u in urls:
        path = tmp_path / pages.page_path(u)
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"<p>{u}</p>", encoding="utf-8")
    spark.dataSource.register(pages.SavedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("saved_pages").load(str(tmp_path))
        assert {(r.url, r.html) for r in df.collect()} == {(u, f"<p>{u}</p>") for u in urls}
        assert df.rdd.getNumPartitions() == 5 and spark.read.format("saved_pages").load(f"file://{tmp_path}").count() == 21
        some = df.where("host = 'h1.org'")
        assert some.rdd.getNumPartitions() == 1 and some.count() == 5
        assert df.where("host IN ('h1.org', 'h2.org', 'none') AND html LIKE '%ü%'").count() == 10
        assert spark.read.format("saved_pages").load(str(tmp_path / "none")).count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("cut", [1, 9, 23, 24, 25, 26, 27, 40])
def test_frames_cut_over_batches(spark, tmp_path, cut):
    raw = "data: {\"event\": \"ping\"}\n\nevent: stage\ndata: one\ndata: two\n\n: comment\n\n\ndata:last\r\n\ndata: never ended".encode()
    spark.dataSource.register(pages.Frames)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def drain():
        q = spark.readStream.format("frames").load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()

    (folder / "a").write_bytes(raw[:cut])
    (folder / "b").write_bytes(b"data: other\n\n")
    drain()
    (folder / "a").write_bytes(raw)
    drain()
    got = [(r.path[-1], r.event, r.data) for r in spark.read.parquet(out).orderBy("path", "at").collect()]
    assert got == [("a", None, '{"event": "ping"}'), ("a", "stage", "one\ntwo"), ("a", None, "last"), ("b", None, "other")]
