from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from paperloom.llm.packing import BatchEncoder, fill, pack_documents

PATH = P.path("word_bpe_49k.json")
ODD = ["".join(map(chr, range(256))), " ".join(chr(i) + "a" + chr(i) * 2 + "1" for i in range(256)), "it's 'sound ,'s ''d I'LL", "<|endoftext|> x", "中文 Ωσς", "", None, "a" * 3000, "123 4.5²¼ x́ ß ẞ \x1c a\x1fb\x85c\xa0d", "word " * 6000]


def test_ids_equal_the_library(spark, sf):
    e = BatchEncoder(PATH)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t, ids in zip(texts, e(texts)):
        assert ids.tolist() == e.whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("room,buffer", [(2048, 1 << 19), (64, 500)])
def test_pieces(spark, sf, room, buffer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = docs.union(odd).coalesce(2)
    e = BatchEncoder(PATH)
    want = {r.doc_id: np.append(e([r.text])[0], 1) for r in docs.collect()}
    rows = pack_documents(docs, PATH, max_tokens=room, buffer_tokens=buffer).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start : r.start + r.length].tolist() and r.length > 0
        assert r.doc_tokens == len(want[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(by_doc[d], len(ids)) for d, ids in want.items()] + [(s, None) for s in by_seq.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == total if total is not None else at <= room
    padded = sum(0 if (n := sum(x[1] for x in s)) & (n - 1) == 0 else room - n for s in by_seq.values())
    assert padded == 0


def test_lowest_cost_first():
    seqs, rest = fill([("a", 0, 60), ("b", 0, 50), ("c", 0, 40), ("d", 0, 40), ("e", 0, 10)], 100)
    assert sorted(sum(p[2] for p in s) for s in seqs) == [100, 100] and not rest
    assert {p[0] for p in seqs[0]} != {p[0] for p in seqs[1]}


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("kind", ["lognormal", "uniform"])
def test_no_piece_is_cut_while_a_sequence_has_room(kind):
    rng, room = np.random.default_rng(3), 2048
    sizes = np.clip(rng.lognormal(5.5, 1, 1400) if kind == "lognormal" else rng.uniform(1, room, 500), 1, room - 1).astype(int).tolist()
    bins = sum(sizes) // room
    free, cost, whole = [room] * bins, [0.0] * bins, set()
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        n = sizes[k]
        able = [(cost[i], i) for i in range(bins) if free[i] >= n]
        if able:
            i = min(able)[1]
            free[i] -= n
            cost[i] += n + n * n / room
            whole.add(k)
    seqs, rest = fill([(k, 0, n) for k, n in enumerate(sizes)], room)
    assert all(sum(p[2] for p in s) == room for s in seqs)
    assert {k for s in seqs for k, start, n in s if n == sizes[k]} == whole
    assert sum(p[2] for s in seqs + [rest] for p in s) == sum(sizes)
    print(kind, len(sizes), "pieces,", len(sizes) - len(whole), "not placed whole")
