import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catsim.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("length,windows", [(64, 4), (4096, 64)])
def test_pieces(spark, length, windows):
    r = random.Random(1)
    bits = ["Hello", "it's", "É", "é", "́x", "日本", "<|endoftext|>", " ", "\x1c", "\x85", "don't", "123", "\t", "İ", "ΣΑΣ", " ", "...", "👍🏽"]
    rows = [(i, "".join(r.choice(bits) + r.choice([" ", "", "\n", "  "]) for _ in range(r.randint(0, 120)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "word " * 9000), (903, " "), (None, "x")]
    df = spark.createDataFrame([(i, t, "o") for i, t in rows], "doc_id long, text string, offset string").repartition(3)
    pieces = packing.pack_documents(df, PATH, length, windows).collect()
    tok = Tokenizer.from_file(PATH)
    docs = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
    assert set(docs) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(docs[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    total = sum(p.length for p in pieces)
    assert len(sequences) <= 1.1 * total / length + 2
    assert len({p.asDict()["sequence_id"] for p in pieces}) == len(sequences)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
