"""Kernels against published values, brute force and properties."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import geo, hashing, sketches, text


def test_murmur3_published_values():
    assert hashing.murmur3_32([b"hello"], 0)[0] == 0x248BFA47
    assert hex(hashing.murmur3_128([b"hello"], 0)[0][0]) == "0xcbd8a7b341bd9b02"
    assert hashing.murmur3_32([b""], 0)[0] == 0


def test_geo_published_values():
    palermo, catania = geo.encode(13.361389, 38.115556), geo.encode(15.087269, 37.502669)
    assert (palermo, catania) == (3479099956230698, 3479447370796909)
    assert geo.decode(palermo) == (13.361389338970184, 38.1155563954963)
    assert (geo.string(palermo), geo.string(catania)) == ("sqc8b49rny0", "sqdtr74hyu0")
    meters = geo.distance(*geo.decode(palermo), *geo.decode(catania))
    assert [f"{meters / geo.UNITS[u]:.4f}" for u in ("m", "km", "ft", "mi")] == ["166274.1516", "166.2742", "545518.8700", "103.3182"]


@given(st.floats(-180, 180), st.floats(-85, 85), st.floats(1, 2_000_000))
@settings(max_examples=200, deadline=None)
def test_geo_areas_cover_the_circle(lon, lat, radius):
    rng = random.Random(1)
    boxes = geo.areas(lon, lat, radius, 0, 0)
    for _ in range(20):
        x, y = rng.uniform(-180, 180), max(-85, min(85, lat + rng.uniform(-20, 20)))
        s = geo.encode(x, y)
        if geo.distance(lon, lat, *geo.decode(s)) <= radius and abs(x - lon) < 170 and abs(lat) < 60:
            assert any(a <= s < b for a, b in boxes)


def test_score_text():
    cases = {1e300: b"1e+300", 1.5e-7: b"1.5e-7", 3.0: b"3", float("inf"): b"inf", 0.1: b"0.1", -0.0: b"-0"}
    assert {k: text.score_text(k) for k in cases} == cases


def test_long_double_sum():
    assert text.long_double_text(text.long_double(b"10.5") + text.long_double(b"0.1")) == b"10.6"
    assert text.long_double(b" 1") is None and text.long_double(b"nan") is None


def test_integers_are_canonical():
    assert text.integer(b"-9223372036854775808") == -(1 << 63)
    assert [text.integer(x) for x in (b"+1", b"007", b" 1", b"9223372036854775808", b"-0")] == [None] * 5


def test_glob():
    cases = [(b"h?llo", b"hello", True), (b"h[^e]llo", b"hello", False), (b"h[a-f]llo", b"hello", True), (b"h\\*", b"h*", True), (b"*x*", b"axb", True), (b"[]", b"a", False)]
    assert [bool(text.glob_regex(p).match(s)) for p, s, _ in cases] == [x for *_, x in cases]


def full_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
@settings(max_examples=200, deadline=None)
def test_lcs_length(a, b):
    out, runs = text.lcs(a.encode(), b.encode())
    assert len(out) == full_table(a, b) == sum(n for *_, n in runs)
    for p, q, n in runs:
        assert a[p : p + n] == b[q : q + n]


def test_lcs_published_values():
    assert text.lcs(b"ohmytext", b"mynewtext") == (b"mytext", [(4, 5, 4), (2, 0, 2)])
    cases = [(b"abcdef", b"fedcba", b"f"), (b"abbab", b"aaabaab", b"abab"), (b"acacbbcaababba", b"abaaab", b"abaaab"), (b"caaabacbcbabcc", b"cbccbbabaabbac", b"cbccbabc")]
    for a, b, want in cases:
        assert text.lcs(a, b)[0] == want


@given(st.lists(st.binary(max_size=40), max_size=60), st.lists(st.binary(max_size=40), max_size=60))
@settings(max_examples=50, deadline=None)
def test_hll_merge_is_union(a, b):
    x, y, z = sketches.Hll(), sketches.Hll(), sketches.Hll()
    x.add(a), y.add(b), z.add(a + b)
    x.merge(y)
    assert (x.registers == z.registers).all()
    assert (sketches.Hll.unpack(x.pack()).registers == x.registers).all()
    assert abs(x.count() - len({*a, *b})) <= 2


def test_hll_accuracy():
    own = sketches.Hll()
    own.add([b"%d" % i for i in range(200_000)])
    assert abs(own.count() / 200_000 - 1) < 0.03


def test_cms_saturates_and_merges():
    own = sketches.Cms(100, 5)
    assert own.add(b"a", 3) == 3 and own.add(b"b", 4) == 4 and own.count(b"z") == 0
    assert own.add(b"a", sketches.U32) == sketches.U32 == own.add(b"a", 1)
    x, y = sketches.Cms(50, 4), sketches.Cms(50, 4)
    x.add(b"k", 2)
    assert y.merge([x, x], [3, -1]) and y.count(b"k") == 4 and y.total == 4
    assert not y.merge([x], [-1]) and y.count(b"k") == 4
    assert (sketches.Cms.unpack(y.pack()).table == y.table).all()


def test_cms_dims():
    assert sketches.cms_dims(0.001, 0.01) == (2000, 7)
    assert sketches.cms_dims(0.01, 1.0) == (0, 0)


def test_bloom_never_forgets_and_grows():
    own = sketches.Bloom(20, 0.01, 2)
    items = [b"i%d" % i for i in range(300)]
    added = sum(own.add(x) for x in items)
    assert all(own.has(x) for x in items) and own.size == added and len(own.links) > 3
    again = sketches.Bloom.unpack(own.pack())
    assert all(again.has(x) for x in items) and again.capacity == own.capacity
    assert sum(own.has(b"other%d" % i) for i in range(2000)) < 100


def test_cuckoo_deletes_and_rolls_back():
    own = sketches.Cuckoo(1024)
    assert (own.buckets, len(own.table) * 2) == (512, 4096)
    items = [b"%d" % i for i in range(900)]
    assert all(own.add(x) for x in items) and all(own.has(x) for x in items)
    assert all(own.delete(x) for x in items) and not own.table.any()
    full = sketches.Cuckoo(1)
    while full.add(b"same"):
        pass
    before, state = full.table.copy(), full.state
    assert not full.add(b"same") and (full.table == before).all() and full.state == state
    assert (sketches.Cuckoo.unpack(own.pack()).table == own.table).all()


def test_morris_median():
    own = sketches.Morris(2000, 5)
    assert own.add(b"hits", 1) == 1 and own.count(b"other") == 0
    found = [own.add(b"x%d" % i, 10_000) for i in range(100)]
    assert abs(np.mean(found) / 10_000 - 1) < 0.15
    assert sketches.Morris.unpack(own.pack()).state == own.state
