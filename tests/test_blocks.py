"""Addresses as numbers, and the smallest block that holds one."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.functions import addresses, urls
from linkrisk.operators import blocks

ODD = """:: ::1 1:: 1::2::3 ::: :::: 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7:8:9 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 1:2:3:4:5:6:7:8:: 1:2:3:4::5:6:7:8 :1::2 1::2: 12345:: g:: ::ffff:10.0.0.1
::10.0.0.256 ::1.2.3 1:2:3:4:5:6:1.2.3.4 1:2:3:4:5:6:7:1.2.3.4 ::01.2.3.4 1.2.3.4:: 1.2.3.4 1.2.3 1.2.3.256 01.2.3.4 [::1] [1.2.3.4] fe80::1%eth0 FE80::A % [] : .""".split()


def parsed(text):
    text = text if "." in text and ":" not in text else text.strip("[]").split("%")[0]
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{int(a) + (0xFFFF << 32 if a.version == 4 else 0):032x}"


def kind_of(text):
    a = ipaddress.IPv6Address(text.strip("[]").split("%")[0])
    return "local" if not a.is_global else "multicast" if a.is_multicast else "global"


def samples():
    """Odd texts, the borders of all special blocks and random addresses in several spellings."""
    rng = random.Random(4)
    out = [*ODD, "", " ::1", "::1 ", "١::"]
    for block in [b for bs in dims.SPECIAL_BLOCKS.values() for b in bs] + list(dims.LOCAL_IPV4):
        net = ipaddress.ip_network(block)
        kind = type(net.network_address)
        for n in (int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1):
            if 0 <= n < 1 << net.max_prefixlen:
                out += [str(kind(n)), kind(n).exploded.upper()]
    for _ in range(300):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))
        out += [str(a), a.exploded, str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    return out


def test_numbers(spark):
    got = spark.createDataFrame([(t,) for t in [*samples(), None]], "a string").select("a", addresses.number(F.col("a"))).collect()
    for text, digits in got:
        assert digits == (None if text is None else parsed(text)), text


def test_prefixes(spark):
    digits = f"{random.Random(1).getrandbits(128):032x}"
    rows = spark.range(129).select("id", addresses.prefix(F.lit(digits), F.col("id")).alias("p"), addresses.prefix(F.lit("f" * 32), F.col("id")).alias("q")).collect()
    bits = f"{int(digits, 16):0128b}"
    for n, p, q in rows:
        rest = n % 4
        for text, all_bits in ((p, bits), (q, "1" * 128)):
            assert text == f"{int(all_bits, 2):032x}"[: n // 4] + (f".{int(all_bits[n - rest : n], 2)}" if rest else "")


def test_special_blocks(spark):
    texts = samples()
    got = dict(blocks.with_kind(spark.createDataFrame([(t,) for t in texts], "a string"), "a", blocks.special_blocks(spark)).collect())
    assert set(got) == set(texts)
    for text, kind in got.items():
        if parsed(text) is None:
            assert kind is None, text
        elif ":" in text and "ffff:" not in text.lower():
            assert kind == kind_of(text), text
    fourth = [t for t in texts if ":" not in t and parsed(t)]
    local = dict(spark.createDataFrame([(t,) for t in fourth], "a string").select("a", urls.is_local_ipv4(F.col("a"))).collect())
    for text in fourth:
        assert (got[text] == "local") == local[text], text
        assert (got[text] == "multicast") == ipaddress.ip_address(text).is_multicast, text


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_any_table_of_blocks(spark, broadcast_rows):
    """Nested blocks of any lengths against a search through all of them; odd blocks; repeated and extra rows."""
    rng = random.Random(9)
    nets = {}
    for i in range(200):
        a = ipaddress.IPv6Address(rng.getrandbits(12) << 116 | rng.getrandbits(8))
        nets[ipaddress.ip_network(f"{a}/{rng.choice([0, 3, 5, 8, 11, 12, 120, 125, 128])}", strict=False)] = f"k{i}"
    table = [(str(n), k) for n, k in nets.items()] + [("x/3", "no"), ("1::/129", "no"), ("1::", "no"), ("1.2.3.0/33", "no"), (None, "no"), ("2::/16", None)]
    asked = [(str(ipaddress.IPv6Address(rng.getrandbits(12) << 116 | rng.getrandbits(8))), i % 3) for i in range(300)]
    asked += [asked[0], ("bad", 1), (None, 2)]
    df = spark.createDataFrame(asked, "a string, extra int")
    got = {(r.a, r.extra): r.kind for r in blocks.with_kind(df, "a", spark.createDataFrame(table, "block string, kind string"), "none", broadcast_rows).collect()}
    assert set(got) == set(asked)
    for (text, extra), kind in got.items():
        held = [n for n in nets if parsed(text or "") and ipaddress.ip_address(text) in n]
        assert kind == (None if not parsed(text or "") else nets[max(held, key=lambda n: n.prefixlen)] if held else "none"), text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "block string, kind string")
    rows = spark.createDataFrame([("::1",), (None,)], "a string")
    assert sorted(map(tuple, blocks.with_kind(rows, "a", none).collect()), key=str) == [("::1", "global"), (None, None)]
    assert blocks.with_kind(rows.limit(0), "a", blocks.special_blocks(spark)).count() == 0
