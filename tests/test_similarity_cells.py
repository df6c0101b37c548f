import random
from itertools import combinations

import pyarrow as pa
import pytest

from sparkloom.operators import similarity

SCHEMA = "claim_id string, claim_text string, topic_tags array<string>"


def claims(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["the", "of"] * 20
    rows = []
    for i in range(n):
        base = rng.choice(rows)[1].split() if rows and rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.choice((1, 3, 8, 20, 70)))]
        rows.append((f"c{i:03}", " ".join([*base[: rng.randrange(1, len(base) + 1)], *rng.sample(words, 3)]), rng.choice((["a"], ["b", "a"], ["z", None, "a"], ["b"], None))))
    return rows + [rows[0], ("n1", None, ["a"]), ("n2", "!", ["a"]), (rows[3][0], None, ["only here"]), ("n3", rows[3][1], ["only here"])]


def brute(rows):
    sets, tags = {}, {}
    for key, text, names in rows:
        tags.setdefault(key, set()).update(x for x in names or [] if x is not None)
        if text is not None:
            sets[key] = set(text.replace("!", "").split())
    return {
        (a, b): (",".join(sorted(tags[a] & tags[b])), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 3))
        for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and tags[a] & tags[b] and 20 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])
    }


def test_tags_in_blocks_equal_brute_force_and_no_candidate_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "HEAVY", 25)
    rows = claims(4, 150)
    found = similarity.candidate_pairs(spark.createDataFrame(rows, SCHEMA))
    got = [(r.claim_id_a, r.claim_id_b, r.shared_tags, r.token_overlap) for r in found.collect()]
    want = brute(rows)
    assert {(a, b): (t, o) for a, b, t, o in got} == want and len(got) == len(want) > 100
    assert any("only here" in t for t, _ in want.values())
    # rows by claim and rows by cell; pairs are verified where they meet
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [2, 48])
def test_cells_cut_by_batches_and_sides(monkeypatch, few):
    monkeypatch.setattr(similarity, "BLOCK", 30)
    monkeypatch.setattr(similarity, "FEW", few)
    monkeypatch.setattr(similarity, "AT_ONCE", 64)
    rng = random.Random(few)
    rows = [(cell, -1 if cell % 2 else rng.randrange(2), 0, f"{cell}-{k}", ["t"], sorted(rng.sample(range(12), 6)), [1 << 40]) for cell in range(7) for k in range((3, 50, 9)[cell % 3])]
    types = [pa.int64(), pa.int8(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int16()), pa.list_(pa.int64())]
    names = ["cell", "side", "nth", "key", "tags", "common", "other"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 11]), types)], names=names) for k in range(0, len(rows), 11)]
    got = [(*sorted((r["x"], r["y"])), r["common"], r["n_all"]) for b in similarity._pairs_of_cells(3, 5)(iter(batches)) for r in b.to_pylist()]
    want = set()
    for x, y in combinations(rows, 2):
        both, every = {*x[5], -1} & {*y[5], -1}, {*x[5], -1} | {*y[5], -1}
        if x[0] == y[0] and (x[1] < 0 or x[1] != y[1]) and 5 * len(both) >= 3 * len(every):
            want.add((*sorted((x[3], y[3])), len(both), len(every)))
    assert set(got) == want and len(got) == len(want) > 50


def test_numbers_keep_counts_of_claims_and_no_pairs(spark, monkeypatch):
    kept = []
    cut = similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: (kept.append(df.columns), cut(df))[1])
    rows = [(f"a{k % 7}", f"b{k * 37 % 101:03}", "t") for k in range(101)] + [("a9", "b1", "t"), ("a9", "b1", "u")]
    got = sorted(tuple(r) for r in similarity.numbered(spark.createDataFrame(rows, "claim_id_a string, claim_id_b string, shared_tags string")).select("candidate_id", "claim_id_a", "claim_id_b").collect())
    assert got == [(f"P{k:03}", a, b) for k, (a, b, _) in enumerate(sorted(rows), 1)]
    assert kept and not any("claim_id_b" in c for c in kept)
