import zlib

import numpy as np
from tokenizers import Tokenizer

from tideline.llm import training_order as T
from tideline.llm.tokens import default_path


def test_permutation():
    for m in (1, 2, 3, 7, 64, 65, 1000, 4097):
        i = np.arange(m)
        p = T.permute(i, m, 5)
        assert sorted(p) == list(range(m)) and (T.permute(p, m, 5, back=True) == i).all()
        assert m < 64 or (T.permute(i, m, 6) != p).mean() > 0.9
    big = T.permute(np.array([0, 1, 10**12 - 1]), 10**12, 9)
    assert (big < 10**12).all() and (T.permute(big, 10**12, 9, back=True) == [0, 1, 10**12 - 1]).all()


def test_round_trip_through_shards(spark, tmp_path):
    texts = [None, "", " ", "one two three", "the same text"] + ["the same text"] * 20 + ["word %d " % i * (i % 40) for i in range(60)] + ["\n\r\n\x00 odd"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "one two three", 1), (None, "no id", 1)]
    got = T.materialise(spark.createDataFrame(rows, "doc_id long, text string, slot int"), length=16, shard=20).persist()
    T.write_shards(got, f"{tmp_path}/out")
    whole = Tokenizer.from_file(default_path())
    want = []
    for i, t, _ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, T.END], "<u4")
        n = -(-len(ids) // 16)
        first = len(ids) - 16 * (n - 1)
        for k in range(n):
            a, b = (0, first) if not k else (first + 16 * (k - 1), first + 16 * k)
            want.append((str(i), k, ids[a:b].tolist()))
    table = got.collect()
    assert sorted(r.slot for r in table) == list(range(len(want))) and all(r.slot == r.shard * 20 + r["at"] for r in table)
    by_slot = {r.slot: r for r in table}
    read = list(T.read_shards(f"{tmp_path}/out", 0, 16, 20))
    assert len(read) == len(want)
    back = []
    for s, ids in enumerate(read):
        r = by_slot[s]
        assert len(ids) == 16 and (ids[r.n_tokens :] == T.END).all() and bytes(r.record) == ids.tobytes()
        assert zlib.crc32(ids[: r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32
        back.append((str(r.doc_id), r.seq, ids[: r.n_tokens].tolist()))
    assert sorted(back) == sorted(want)
    assert [x.tolist() for x in T.read_shards(f"{tmp_path}/out", 33, 16, 20)] == [x.tolist() for x in read[33:]]
    assert T.materialise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stored_sequences_keep_their_order(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    place = lambda d: {r.doc_id: r.slot for r in T.materialise(d, length=16, store=f"{tmp_path}/store").collect()}
    first = place(d)
    assert place(d.repartition(5, "text")) == first and sorted(first.values()) == list(range(40))


def test_wide_records_and_growing_shards(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text number {i}") for i in range(5)], "doc_id long, text string")
    for r in T.materialise(d, length=16, wide=True).collect():
        assert len(r.record) == 64 and zlib.crc32(bytes(r.record)[: 4 * r.n_tokens]) == r.ids_crc32
    assert [T.shard_size(m) for m in (0, 1, T.SHARD << 16, (T.SHARD << 16) + 1)] == [T.SHARD, T.SHARD, T.SHARD, 2 * T.SHARD]
