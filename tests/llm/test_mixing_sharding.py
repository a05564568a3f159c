"""Mixing (9) and sharding (4) against brute force."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from commitlens.llm import mixing, sharding

from .conftest import ODD


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    """Caps at three times the size; the excess is reshared by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, total, out = set(order), float(sum(sizes.values())), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        above = {s for s in left if weight[s] * level > 3 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in left}
        out |= {s: 3.0 * sizes[s] for s in above}
        left -= above
    return out


def check_mix(rows, got, block):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    targets, taken = brute_targets(dict(sizes)), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 3.5 * block, s


def test_mix_odd_rows(odd, empty):
    got = mixing.mix(odd, block=8).collect()
    check_mix(ODD, got, 8)
    again = mixing.mix(odd.repartition(7), block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_mix_hot_source_and_kept_rows(make_docs):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randrange(0, 60))), "en", rnd.choice(["hot"] * 9 + ["b", "c", "d", None])) for i in range(600)]
    docs = make_docs(rows)
    check_mix(rows, mixing.mix(docs).collect(), mixing.BLOCK)
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    want = Counter({r["doc_id"]: (2 * r["taken"] + r["size"]) // (2 * r["size"]) for r in mixing.mix(docs).collect() if r["size"]})
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == +want


def test_rows_of_one_id_and_text_keep_their_sources(make_docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(7, text, "en", s) for s in ("a", "b", "c", None)] + [(None, text, "en", s) for s in ("a", None)]
    docs = make_docs(rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"])
    assert len(+want) > 2
    assert Counter((r["doc_id"], r["source"]) for r in mixing.take_mix(docs).collect()) == +want


def test_apportion_is_highest_quotients(spark):
    rnd = random.Random(4)
    parties = [(f"s{i:02d}", i, float(rnd.choice([0, 1, 1, 5, 40, 333, 333, 5000]))) for i in range(15)]
    df = spark.createDataFrame(parties, "source string, rank int, target double")
    seats = [0, 1, 7, 100, 999]
    got = {(r["house"], r["source"]): r["seats"] for r in mixing.apportion(df, seats).collect()}
    for h, n in enumerate(seats):
        quotients = sorted(((-t / (2 * j - 1), i, s) for s, i, t in parties if t > 0 for j in range(1, n + 2)))[:n]
        want = Counter(s for *_, s in quotients)
        assert {s: c for (k, s), c in got.items() if k == h and c} == dict(want)


def test_shards_take_their_quotas_of_blocks(make_docs):
    """Word by word: shard after shard walks its blocks around the seeded order of each source."""
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(0, 90), "en", rnd.choice(["hot"] * 6 + ["b", None])) for i in range(300)]
    docs, block = make_docs(rows), 16
    m = mixing.plan_mix(docs, block=block)
    facts = {r["source"]: r for r in m.sources.collect()}
    quotas = {(r["source"], r["shard"]): r["quota"] for r in m.quotas.collect()}
    want = {}
    for s, f in facts.items():
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest(), r[0]))
        stream = [r[0] for r in mine for _ in range(words(r[1]))]
        at = f["first"]
        want |= {r[0]: [0] * mixing.SHARDS for r in mine}
        for shard in range(mixing.SHARDS):
            for _ in range(quotas.get((s, shard), 0)):
                for d in stream[at % f["blocks"] * block:(at % f["blocks"] + 1) * block]:
                    want[d][shard] += 1
                at += 1
    got = mixing.mix(docs, block=block).collect()
    assert {r["doc_id"]: r["shard_words"] for r in got} == want
    assert all(sum(r["shard_words"]) == r["taken"] for r in got) and all(len(set(w)) > 1 for w in want.values() if sum(w) % 8)


def test_quotas_of_shards_add_up(make_docs):
    rows = [(i, "w " * (i % 50), "en", "abc"[i % 3]) for i in range(300)]
    m = mixing.plan_mix(make_docs(rows))
    total = {r["source"]: r["seats"] for r in m.sources.collect()}
    sums = Counter()
    for r in m.quotas.collect():
        assert r["quota"] >= 0
        sums[r["source"]] += r["quota"]
    assert dict(sums) == total


# ---- sharding ----------------------------------------------------------------------------------

def brute_capacity(sizes, shards):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards
    lo, hi = 0, sum(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def check_shards(rows, got, shards=8):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, bytes_, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        where[r["size"], r["text_crc32"]].add(r["shard"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    groups = Counter()
    for _, t, *_ in rows:
        groups["" if t is None else hashlib.sha256(t.encode()).hexdigest()] += size(t)
    assert max(bytes_.values()) == brute_capacity([groups[k] for k in sorted(groups)], shards)
    assert all(len(w) == 1 for k, w in where.items() if k[1])


def test_shards_odd_rows(odd, empty):
    check_shards(ODD, sharding.shard_rows(odd).collect())
    assert sharding.shard_rows(empty).count() == 0


@pytest.mark.parametrize("seed,copies,shards", [(1, 1, 8), (2, 200, 8), (3, 5, 3), (4, 1, 1)])
def test_shards_are_minimax(make_docs, monkeypatch, seed, copies, shards):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)  # several rounds of splitting
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rnd = random.Random(seed)
    rows = [(i, "t" * rnd.randrange(1, 400) + str(rnd.randrange(150)), "en", "a") for i in range(400)]
    rows += [(1000 + i, "hot text " * 5, "en", "a") for i in range(copies)]
    check_shards(rows, sharding.shard_rows(make_docs(rows), shards).collect(), shards)


def test_shards_beside_a_hot_group_are_near_equal(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rows = [(i, f"text number {i} " * 6, "en", "a") for i in range(2000)] + [(5000 + i, "hot text " * 12, "en", "a") for i in range(1000)]
    got = sharding.shard_rows(make_docs(rows)).collect()
    check_shards(rows, got)
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    hot = max(sums, key=sums.get)
    rest = [n for s, n in sums.items() if s != hot]
    assert len(rest) == 7 and min(rest) > 0.5 * sum(rest) / 7 and max(rest) < 1.5 * sum(rest) / 7


def test_even_cuts_keep_the_capacity():
    rnd = random.Random(12)
    for _ in range(200):
        sizes = [rnd.choice([1, 2, rnd.randrange(1, 30), rnd.randrange(1, 300)]) for _ in range(rnd.randrange(1, 40))]
        shards = rnd.randrange(1, 10)
        cells = sharding._cells([(f"{i:02d}", n, 1) for i, n in enumerate(sizes)])
        capacity = brute_capacity(sizes, shards)
        ends, unsure = cells.even_cuts(capacity, shards)
        edges = [0, *ends, sum(sizes)]
        assert not unsure and set(edges) <= set(itertools.accumulate(sizes, initial=0))
        runs = [b - a for a, b in zip(edges, edges[1:])]
        assert len(runs) == shards and max(runs) <= capacity


def test_fewer_groups_than_shards(make_docs):
    rows = [(i, "abc"[i % 3], "en", "a") for i in range(9)]
    got = sharding.shard_rows(make_docs(rows)).collect()
    check_shards(rows, got)
    assert len({r["shard"] for r in got}) == 3


def test_greedy_bounds_enclose_the_truth():
    rnd = random.Random(9)
    for _ in range(50):
        sizes = [rnd.randrange(1, 30) for _ in range(40)]
        cells = sharding._cells([(f"{i:02d}", sum(sizes[4 * i:4 * i + 4]), 4) for i in range(10)])
        edges = list(itertools.accumulate(sizes, initial=0))
        for c in (20, 60, 90, 130):
            p = 0
            for low, high in cells.cuts(c, 8):
                p = max(e for e in edges if e <= p + c)
                assert low <= p <= high
