import random
import re

import numpy as np
import xxhash

from pagestream.llm import simhash as S
from pagestream.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def print_of(text, size=3):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids, root = sorted(prints), {}
    for i in ids:
        root[i] = i
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_golay_keys_share_within_two_bits():
    r = np.random.default_rng(1)
    w = r.integers(0, 1 << 23, 300)
    row, key = S.golay_keys(w)
    assert set(np.bincount(row)) <= {1, 6}
    own = [set(key[row == k].tolist()) for k in range(len(w))]
    for a in range(23):
        for b in range(a, 23):
            row2, key2 = S.golay_keys(w ^ (1 << a) ^ ((1 << b) if b != a else 0))
            other = [set() for _ in w]
            for x, y in zip(row2.tolist(), key2.tolist()):
                other[x].add(y)
            assert all(x & y for x, y in zip(own, other))


def test_links_find_all_components(spark, monkeypatch):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(r.randrange(0, 12)):
            b ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            prints.add(b)
    prints.add(0)
    want = brute_components({x: x for x in prints})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    for limit in (2048, 3):
        monkeypatch.setattr(S, "GROUP_LIMIT", limit)
        got = {x & (2**64 - 1): y & (2**64 - 1) for x, y in components(S.links(spark.createDataFrame(signed, "fp long"))).collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
        assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    words = [f"wörd{k}" for k in range(50)] + ["The", "AND", "ÀÉ"]
    rows = [(k * 2, " ".join(r.choice(words) for _ in range(r.randrange(1, 200)))) for k in range(60)]
    for k in range(30):
        w = rows[k][1].split(" ")
        w[r.randrange(len(w))] = "edit"
        rows.append((1001 + k, "\n".join(w)))
    rows += [(7, None), (9, ""), (11, " \t "), (13, "one two"), (15, "ONE  two"), (3, rows[0][1])]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    prints = {i: print_of(t) for i, t in rows}
    want = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert got[7] == ("0" * 16, 7) and got[9][1] == got[11][1] == 7 and got[15][1] == 13


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
