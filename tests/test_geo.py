"""Address keys and range lookup against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from logspark.operators import enrich

ODD = [
    "", "1.2.3", "1.2.3.256", "1.2.3.4.5", "a", ":", ":::", "::", "::1", "1::", "2001:db8::1::2", "2001:db8:0:0:0:0:0:1", "2001:DB8::1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "g::", "12345::", "::ffff:1.2.3.4", "::1.2.3.4", "::ffff:1.2.3.999", "0.0.0.0", "255.255.255.255", None,
    ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "fe80::1%eth0",
]


def key(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    if a.version == 6 and a.scope_id:
        return None
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    return f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"


def addresses(rng, n):
    out = []
    for _ in range(n):
        a = ipaddress.IPv4Address(rng.randrange(1 << 32)) if rng.random() < 0.5 else ipaddress.IPv6Address(rng.randrange(1 << 16) << rng.choice([0, 64, 100, 112]))
        out.append(rng.choice([str(a), a.exploded.upper()]) if a.version == 6 else str(a))
    return out


def test_keys(spark):
    texts = ODD + addresses(random.Random(1), 300)
    got = spark.createDataFrame([(t,) for t in texts], "v STRING").select("v", enrich.address_key(F.col("v")).alias("k")).collect()
    assert {r.v: r.k for r in got} == {t: key(t) for t in texts}


def test_ranges_of_any_width(spark):
    rng = random.Random(2)
    ranges = [("0.0.0.0", "9.255.255.255", "A"), ("10.0.0.0", "10.0.0.7", "B"), ("10.0.0.9", "10.0.0.9", "C"), ("11.0.0.0", "11.0.255.255", "D"), ("::1", "::ffff", "E"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "F"), ("bad", "1.1.1.1", "X")]
    asked = [f"10.0.0.{i}" for i in range(12)] + ["11.0.1.2", "11.1.0.0", "::", "::1", "::ffff", "::1:0", "2001:db8::5", "2001:db9::", "2001:db7:ffff::", "::ffff:10.0.0.9", "none", None, *addresses(rng, 100)]
    want = {}
    for a in asked:
        hits = [c for lo, hi, c in ranges if key(a) and key(lo) and key(lo) <= key(a) <= key(hi)]
        want[a] = hits[0] if hits else None
    table = spark.createDataFrame([(*r, None, None) for r in ranges], "first_ip STRING, last_ip STRING, country STRING, region STRING, city STRING")
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(asked + asked)], "id INT, client_ip STRING")
    got = enrich.add_geo(rows, table).collect()
    assert len(got) == 2 * len(asked)
    assert {r.client_ip: (r.geo.country if r.geo else None) for r in got} == want
    assert enrich.add_geo(rows, table.limit(0)).where("geo IS NOT NULL").count() == 0
