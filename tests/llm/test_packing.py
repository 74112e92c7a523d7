import random
import zlib

import numpy as np
import pytest

from gridcast.llm import packing
from gridcast.llm.registry import tokenizer_path

TEXTS = [
    "Hello, world. It's 12 o'clock!",
    None,
    "",
    "a,b. c!, d., e.. ÉCOLE, naïve. é ́x  two  spaces\ttab nbsp\x1cfs",
    "<|endoftext|> in <|startoftext|>text a<|endoftext|>b <|x",
    "x" * 9000,
    "word, Word. WORD " * 3000,
    "ǅ İstanbul Σίσυφος. 日本語 テキスト 🙂🙂",
    "same",
    "same",
]


def test_chunks_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    own = packing.ChunkTokenizer(tokenizer_path())
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("aB'.,!é́ \n\t1st<|>s") for _ in range(200)) for _ in range(300)]
    texts += ["".join(rng.choice("aÉéß×÷.,!Aª°1\xa0 \n'") for _ in range(200)) for _ in range(300)]
    texts += [" ".join(rng.choice(["Été,", "l'eau.", "12,5", "x.", "$$$", "don't", "a,b"]) for _ in range(50)) for _ in range(50)]
    for _ in range(2):
        got = own.encode(texts)
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip(spark, parts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = [(i if i != 3 else None, t, i, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, sequence_id int").repartition(parts)
    got = packing.pack(docs, tokenizer_path(), window=64).toPandas()
    assert sum(got.length) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in TEXTS)
    for _, piece in got.iterrows():
        assert zlib.crc32(piece.ids) == piece.ids_crc32 and len(piece.ids) == 4 * piece.length
    by_window = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for k, own in by_window:
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.length.sum() == 64 or k == got.sequence_id.max()
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.max() + 1))
    for i, t in enumerate(TEXTS[:8]):
        own = got[got.doc_id.isna()] if i == 3 else got[got.doc_id == i]
        own = own.sort_values("start")
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert (own.doc_tokens == len(ids)).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, tokenizer_path()).count() == 0
