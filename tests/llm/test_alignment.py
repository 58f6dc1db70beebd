import hashlib
import random
from collections import Counter

import pytest
from tideline.llm import alignment, tokens

ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "two  spaces", " led", "\n\nlines\n", "tail \t", "a▁b", "naïve ﬁ 中文 🙂\x00", "a\nb\nc", "\r\nx;\r\ny", "don't  ", " x y"]


def aligned(texts):
    """Whole texts, plain loops."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    A.encode_special_tokens = True
    B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = tokens._visible()
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    rows, count = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = [(i, bytes(byte[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(B.id_to_piece(i))) for i in B.encode(text)]
            if any(b"".join(x for _, x in t) != b" " + text.encode() for t in (a, b)):
                a = b = []
        ends = []
        for t in (a, b):
            at, e = 0, {}
            for k, (_, x) in enumerate(t):
                at += len(x)
                e[at] = k
            ends.append(e)
        links, groups, i, j = [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            ka, kb = ends[0][at], ends[1][at]
            links.append((a[ka][0], b[kb][0]))
            groups.append(",".join(str(x) for x, _ in a[i : ka + 1]) + "|" + ",".join(str(x) for x, _ in b[j : kb + 1]))
            i, j = ka + 1, kb + 1
        count.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(na, nb, g, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), sha) for na, nb, g, ls, sha in rows]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def compare(rows, got):
    want = sorted((str(i), *r) for (i, _), r in zip(rows, aligned([t for _, t in rows])))
    assert sorted((str(r["doc_id"]), *(r[c] for c in NAMES)) for r in got) == want


def test_odd_texts(spark, docs):
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", *ODD, *ODD[:3], "word " * 3000, "x" * 5000])]
    rows += [(100 + i, "".join(r.choices(["a", "the", " ", "\n", "  ", "é", "Zq", "\t", "'s", "12", ".", "中"], k=60))) for i in range(40)] + [(None, "null id"), (3, "again"), (3, "again")]
    compare(rows, alignment.link_counts(docs(rows)).collect())


def test_blocks_and_steps_do_not_matter(spark, docs, monkeypatch):
    rows = [(i, f"Number {i} of some texts, naïve ones {i * 7}.") for i in range(60)]
    s = alignment.sides(tokens.default_path(), alignment.piece_path())
    whole = alignment.align_batch(s, [t for _, t in rows]).to_pylist()
    parts = [x for k in range(0, 60, 7) for x in alignment.align_batch(s, [t for _, t in rows[k : k + 7]]).to_pylist()]
    pairs = lambda x: x | {"pairs": sorted(zip(x["pairs"], x["times"])), "times": None}
    assert list(map(pairs, whole)) == list(map(pairs, parts))
    compare(rows, alignment.link_counts(docs(rows).repartition(7)).collect())  # seven blocks


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_no_tokens(spark, docs, rows):
    got = alignment.link_counts(docs(rows)).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_query_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    compare(rows, alignment.op12_alignment(spark, sf).collect())
    extra = d.limit(5).withColumns({c: F.lit("x") for c in ("block", "pairs", "n_a", "key", "row")})
    compare([tuple(r) for r in d.limit(5).select("doc_id", "text").collect()], alignment.link_counts(extra).collect())
