import random

import pytest

from sparkloom.llm import packing, tokens

pytestmark = pytest.mark.filterwarnings("ignore")
RANKS = tokens.vocabulary()
TEXTS = [
    None, "", " ", "\n\n\n", "a", "Ärger über 3.5 Dinge, isn't it?", "<|endoftext|> is text", "x" * 5000, " " * 3000 + "y", "\n \n\n  b" * 400, "don't " * 900, "日本語のテキスト" * 300,
    "a b\r\nc\t\td" * 200, "'s't're've" * 300, "word " * 2000, "1234567890" * 200,
]


def whole(text):
    return tokens._encoding(RANKS).encode_ordinary(text) if text else []


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (1000, 64), (8192, 256)])
def test_chunks_give_the_ids_of_the_whole(spark, chunk, overlap):
    rows = [(i, t, [1], 9) for i, t in enumerate(TEXTS)] + [(14, TEXTS[14], [2], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n int")
    got = tokens.encode_corpus(df, "doc_id", "text", RANKS, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((i, whole(t)) for i, t, *_ in rows)


def test_decoding_is_a_round_trip():
    for t in TEXTS:
        assert tokens.decode(whole(t), RANKS) == (t or "").encode()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(empty, "doc_id", "text", RANKS).count() == 0
    assert packing.pack_documents(empty, "doc_id", "text", RANKS).count() == 0


def test_best_fit():
    fit = packing.BestFit(10, 2)
    assert [fit.place(s) for s in (6, 7, 3, 4, 9)] == [0, 1, 1, 0, 2]
    assert sorted(fit.closed) == [0, 1]


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_keeps_every_piece_and_splits_only_the_long(spark, parts):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(0, 60)) for i in range(800)] + [(900, "word " * 1000), (901, None), (902, ""), (3, "word " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = packing.pack_documents(df, "doc_id", "text", RANKS, capacity=100, open_bins=8, fan_in=2).collect()
    used: dict = {}
    pieces: dict = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert max(used.values()) <= 100
    sizes = [len(whole(t)) for _, t in rows]
    assert sum(used.values()) == sum(sizes)
    assert all(len(p) == 1 for d, p in pieces.items() if d not in (3, 900))
    long = sorted(pieces[900])
    assert [p[2] for p in long[:-1]] == [100] * (len(long) - 1) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:]))
    assert len(used) <= 1.1 * -(-sum(sizes) // 100) + 2


def test_lower_bound_of_fill_on_the_driver_table(spark, sf):
    from pyspark.sql import functions as F

    from sparkloom.llm.queries import QUERIES

    r = QUERIES["p8_containers"](spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("bins")).first()
    assert r["most"] <= 2048 and r["bins"] <= -(-r["all"] // 2048) + 2


def test_closed_windows_stay_out_of_later_rounds(spark, monkeypatch):
    merge = packing._merge

    def bounded(capacity, limit):
        run = merge(capacity, limit)

        def watched(batches):
            held = list(batches)
            assert sum(b.num_rows for b in held) <= 2 * limit, "more than fan_in * open_bins windows in a task"
            return run(iter(held))

        return watched

    monkeypatch.setattr(packing, "_merge", bounded)
    df = spark.createDataFrame([(i, "word " * (55 + i % 20)) for i in range(120)], "doc_id long, text string").repartition(16)
    got = packing.pack_documents(df, "doc_id", "text", RANKS, capacity=100, open_bins=2, fan_in=2).collect()
    filled = {}
    for r in got:
        filled[r.container] = filled.get(r.container, 0) + r.n_tokens
    assert sorted(r.doc_id for r in got) == list(range(120)) and max(filled.values()) <= 100
