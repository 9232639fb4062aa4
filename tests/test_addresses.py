"""Addresses, subnets and renames against Python's own."""

import ipaddress
import random

from pyspark.sql import functions as F

from tests_support import make
from tracequarry.functions import net
from tracequarry.model import EventSet
from tracequarry.operators import engine, entities


def texts(seed, n):
    """Random addresses in many spellings, and near misses."""
    rng = random.Random(seed)
    out = ["", " ", ":", "::", ":::", "::1", "1::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3.4", "::ffff:1.2.3.256", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "127.0.0.1", "127.9.9.9", "0.0.0.0", "g::1", "12345::", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "[::1]", "[fe80::1]:445", "[10.1.2.3]", "fe80::1%12", " 10.0.0.1 ", "x", "-", "١.1.1.1", None]
    for _ in range(n):
        if rng.random() < 0.3:
            out.append(str(ipaddress.IPv4Address(rng.choice((rng.getrandbits(32), 10 << 24 | rng.getrandbits(16))))))
            continue
        a = ipaddress.IPv6Address(sum(rng.choice((0, 0, 1, rng.getrandbits(16), 0xFE80)) << 16 * k for k in range(8)) if rng.random() < 0.8 else 0xFFFF << 32 | rng.getrandbits(32))
        s = rng.choice((str(a), a.exploded, a.exploded.upper(), ":".join(f"{int(a) >> 16 * k & 0xFFFF:x}" for k in range(7, -1, -1))))
        out.append(rng.choice((s, s, f"[{s}]", f" {s}", s[:-1], s + ":", s + "%eth0")))
    return out


def parsed(text, zone):
    s = text.strip()
    if s.startswith("[") and "]" in s:
        s = s[1 : s.index("]")]
    s = s.split("%", 1)[0] if zone else s
    if "%" in s:
        return None
    try:
        return ipaddress.ip_address(s)
    except ValueError:
        return None


def test_keys_and_subnets_against_ipaddress(spark):
    rows = texts(1, 1500)
    nets = ["10.0.0.0/8", "0.0.0.0/0", "10.0.1.2", "::/0", "fe80::/10", "fe80::/64", "1::/16", "::ffff:0:0/96", "::1/128", "1:0:0:1::/63"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", net.ip_key_of(F.col("t")).alias("key"), *[net.in_subnet(F.col("t"), n).alias(f"n{k}") for k, n in enumerate(nets)])
    joined = {(r["i"], r["net"]) for r in net.in_networks(df, "t", list(enumerate(nets))).collect()}
    for r in got.collect():
        text = rows[r["i"]]
        a = None if text is None else parsed(text, False)
        if a is not None and a.version == 6 and a.ipv4_mapped is not None:
            a = a.ipv4_mapped
        assert r["key"] == (None if a is None or a.is_loopback or a.is_unspecified else str(a)), text
        b = None if text is None else parsed(text, True)
        for k, n in enumerate(map(net.network, nets)):
            c = b.ipv4_mapped or b if b is not None and b.version == 6 and n.version == 4 else b
            inside = c is not None and c.version == n.version and c in n
            assert r[f"n{k}"] == inside == ((r["i"], k) in joined), (text, nets[k])


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([(1, "fe80::1", ["fe80::1", "x"])], "id long, a string, b array<string>")
    events = EventSet.from_dataframe(df, id="id", fields=["a", "b"])
    found = engine.run(events, "a cidr fe80::/10 and b cidr fe80::/64").events
    assert found.count() == 1 and "Python" not in found._jdf.queryExecution().toString()
    assert "Python" not in df.select(net.ip_key_of(F.col("a")))._jdf.queryExecution().toString()


def test_renames_follow_the_loop(spark):
    """100,000 renames: chains longer and shorter than the bound, a circle, several new names for one old one."""
    n = 100_000
    pairs = [(f"H{i}", f"H{i + 1}") for i in range(0, n) if i % 40] + [("C0", "C1"), ("C1", "C2"), ("C2", "C0"), ("A", "B"), ("A", "D"), ("S", "S"), ("x.dom", "Y$"), ("-", "Q")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a string, b string").select("id", F.array("a", "b").alias("Data"), F.lit("6011").alias("e"), F.lit("EventLog").alias("p"))
    events = EventSet.from_dataframe(df, id="id", fields=["Data"], system={"@EventID": "e", "@Provider": "p"})
    got = {r["old"]: r["final"] for r in entities.renames(events).collect()}
    short = lambda s: None if s == "-" else s.rstrip("$").split(".")[0].upper()
    table = {short(a): short(b) for a, b in pairs if short(a) and short(b) and short(a) != short(b)}

    def final(k):
        hops = 0
        while k in table and hops < 16:
            k, hops = table[k], hops + 1
        return k

    assert got == {k: final(k) for k in table} and got["C0"] == final("C0") and got["A"] == "D" and got["X"] == "Y"


def test_hosts_take_their_last_name(spark):
    rows = [(1, 6011, {"@provider": "EventLog", "@channel": "System", "Data": None}, "NEW"), (2, 4624, {"WorkstationName": "old.dom"}, "NEW"), (3, 4624, {"WorkstationName": "OLD"}, "OTHER")]
    e = make(spark, rows, ["WorkstationName", "Data"])
    df = e.df.withColumn("Data", F.when(F.col("n") == 6011, F.array(F.lit("OLD"), F.lit("NEW"))))
    events = EventSet.from_dataframe(df, id="id", fields=["WorkstationName", "Data"], system={"@EventID": F.col("n"), "@Channel": "channel", "@Provider": "provider", "@Computer": "computer"}).with_df(df)
    assert {r["entity"] for r in entities.build(events).entities.collect()} == {"host|NEW", "host|OTHER"}
