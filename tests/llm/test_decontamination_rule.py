"""Every overlap that meets the documented rule, against brute force."""

import random

import numpy as np

from durata.llm import decontamination


def has_segment(match, similarity, least):
    n = len(match)
    return any(
        sum(match[a:b]) >= similarity * (b - a) - 1e-9 for a in range(n) for b in range(a + least, n + 1)
    )


def test_best_segment_against_brute_force():
    rng = random.Random(8)
    assert decontamination.best_segment(np.array([i % 5 != 4 for i in range(40)]), 0.8, 10) == (0, 39)
    for _ in range(400):
        match = [rng.random() < rng.choice([0.6, 0.8, 0.9]) for _ in range(rng.randint(1, 30))]
        for similarity in (0.8, 2 / 3, 1.0):
            got = decontamination.best_segment(np.array(match), similarity, 10)
            assert (got is not None) == has_segment(match, similarity, 10)
            if got:
                a, b = got
                assert b - a >= 10 and sum(match[a:b]) >= similarity * (b - a) - 1e-9


def test_decontamination_at_the_similarity(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(40)]
    fifth = [w if i % 5 != 4 else f"x{i}" for i, w in enumerate(words)]
    items, rows = [(0, " ".join(words))], [(0, " ".join(fifth))]
    for i in range(1, 61):
        item = [f"i{i}w{j}" for j in range(20)]
        copy = list(item)
        for at in rng.sample(range(20), 3):
            copy[at] = "other"
        items.append((i, " ".join(item)))
        rows.append((i, "a b " + " ".join(copy) + " c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.overlap, r.matching) for r in decontamination.contaminated(docs, bench).collect()}
    assert got[0, 0] == (39, 32)
    assert set(got) == {(i, i) for i in range(61)}


def slow_overlaps(docs, items):
    """(doc, item): (overlap, matching), over every diagonal on which some mask agrees."""
    out = {}
    for d, text in docs:
        a = decontamination.tokens(text.encode())
        for i, item in items:
            b = decontamination.tokens(item.encode())
            for shift in range(-len(b) + 1, len(a)):
                low, high = max(0, -shift), min(len(b), len(a) - shift)
                match = [a[k + shift] == b[k] for k in range(low, high)]
                seeded = any(
                    all(match[at + k] for k, c in enumerate(mask) if c == "1")
                    for mask in decontamination.MASKS
                    for at in range(len(match) - len(mask) + 1)
                )
                got = seeded and decontamination.best_segment(np.array(match), 0.8, max(min(10, len(b)), 8))
                if got:
                    found = (got[1] - got[0], sum(match[got[0] : got[1]]))
                    out[d, i] = max(out.get((d, i), found), found)
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(5, 30)))) for i in range(12)]
    items += [(50, items[0][1]), (51, "z " * 30), (52, "")]
    docs = []
    for d in range(40):
        copy = rng.choice(items)[1].split()
        copy = [rng.choice("abcdef") if rng.random() < 0.1 else w for w in copy]
        around = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 15))] for _ in range(2)]
        docs.append((d, " ".join(around[0] + copy + around[1])))
    docs += [(100, docs[0][1]), (101, "z " * 3000), (102, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow_overlaps([d for d in docs if d[0] != 101], items)
    for bits in (decontamination.FILTER_BITS, 64):
        monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
        got = {(r.doc_id, r.item_id): (r.overlap, r.matching) for r in decontamination.contaminated(df, bench).collect()}
        assert got.pop((101, 51)) == (30, 30)
        assert got == want
    clean = {r.doc_id for r in decontamination.decontaminate(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want} - {101}


def test_seeds_are_the_same_in_slices(monkeypatch):
    held = decontamination.TokenHashes().of(b"a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3)

    def found():
        return sorted((w, low + i, x) for low, w, h in decontamination.seed_hashes(held) for i, x in enumerate(h.tolist()))

    want = found()
    assert len(want) == sum(79 - len(mask) for mask in decontamination.MASKS)
    for size in (1, 7, 77):
        monkeypatch.setattr(decontamination, "BATCH", size)
        assert found() == want
