import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as C  # noqa: E402

from tests_llm_helpers import contaminated, norm, similar  # noqa: E402


def fixture(spark, at):
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    item = [rng.choice(vocab) for _ in range(30)]
    for i in range(240):
        w = [rng.choice(vocab) for _ in range(rng.choice([40, 80, 200]))]
        if i % 5 == 0:
            w = [x.upper() + "!!" for x in w]
        elif i % 11 == 0:
            w[3:3] = item[5:17]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 != 0), 0))
    good = [d for d in docs if d[0] % 5 and d[0] % 11]
    docs += [(1000 + k, good[k % 7][1].replace(" ", "  ")) for k in range(30)]  # copies
    for k in range(30):  # near copies
        w = good[20 + k % 6][1].split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((2000 + k, " ".join(w)))
    docs += [(3000, None), (3001, ""), (1, docs[1][1])]
    spark.createDataFrame([(i, t, "en", "s", 3) for i, t in docs], "doc_id long, text string, lang string, predicted string, score long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return item


def test_each_stage_on_its_own_input(spark, tmp_path):
    sf = str(tmp_path)
    item = fixture(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda d: sorted(((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()), key=str)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        before, after = rows(docs), rows(out)
        if name == "quality classifier":
            assert {i for i, _ in before} - {i for i, _ in after} - {3000, 3001} == {i for i, _ in before if i < 1000 and i % 5 == 0}
        elif name == "exact dedup":
            want = {}
            for i, t in before:
                want[norm(t)] = min(want.get(norm(t), (i, t)), (i, t), key=lambda x: x[0])
            assert after == sorted(want.values(), key=str)
        elif name == "n-gram Jaccard join":
            assert {i for i, _ in before if not 2000 <= i < 3000} <= {i for i, _ in after}
            gone = set(before) - set(after)
            assert len(gone) > 15 and all(any(similar(t, u) for _, u in after if u) for _, t in gone)
            texts = [t for _, t in after]
            assert not any(similar(a, b) for k, a in enumerate(texts) for b in texts[:k] if a and b)
        else:
            assert after == [(i, t) for i, t in before if not contaminated(t, item)]
            assert len(after) < len(before)
        out.write.parquet(f"{sf}/{name.replace(' ', '')}")
        docs = spark.read.parquet(f"{sf}/{name.replace(' ', '')}")
    packed = C.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows(docs)}


def test_empty_documents_null_ids_and_long_texts(spark, tmp_path):
    sf = str(tmp_path)
    fixture(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0, name
    (good,) = [r.text for r in docs.where("doc_id = 1").limit(1).collect()]
    rows = [(None, good, "en", "s", 3), (None, good + " more", "en", "s", 3), (None, None, None, None, None), (7, " ".join(f"w{i}" for i in range(60000)), "en", "s", 3), (8, "", "en", "s", 3)]
    odd = spark.createDataFrame(rows, docs.schema)
    for name, stage in C.STAGES[1:]:
        out = stage(spark, odd, sf)
        assert out.count() >= (1 if name == "best-fit packing" else 3), name
    assert C.drop_copies(spark, odd, sf).count() == 4  # null and empty text are copies
    assert C.drop_near_copies(spark, odd, sf).count() == 4  # the two near copies without ids
