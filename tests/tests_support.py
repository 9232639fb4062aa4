"""What several tests need."""

import ipaddress

from pyspark.sql import functions as F

from tracequarry.model import EventSet


def make(spark, rows, fields, channel="Security"):
    """rows: (t, event id, {field: value}, computer); ids follow the order of the list."""
    data = [(i, t, n, f.pop("@channel", channel), f.pop("@provider", "p"), c, f.pop("@sid", None), *[f.get(x) for x in fields]) for i, (t, n, f, c) in enumerate((t, n, dict(f), c) for t, n, f, c in rows)]
    ddl = "id bigint, ts_ft bigint, n int, channel string, provider string, computer string, sid string" + "".join(f", {f} string" for f in fields)
    df = spark.createDataFrame(data, ddl)
    e = EventSet.from_dataframe(df, id="id", fields=fields, system={"@EventID": F.col("n"), "@Channel": "channel", "@Provider": "provider", "@Computer": "computer", "@UserID": "sid"})
    return e.with_df(df)


def inside(text, network):
    """Whether a text is an address of a subnet, by Python's own reading."""
    s = text.strip()
    if s.startswith("[") and "]" in s:
        s = s[1 : s.index("]")]
    try:
        a, n = ipaddress.ip_address(s.split("%", 1)[0]), ipaddress.ip_network(network, strict=False)
    except ValueError:
        return False
    if n.version == 4 and a.version == 6 and a.ipv4_mapped is not None:
        a = a.ipv4_mapped
    return a.version == n.version and a in n
