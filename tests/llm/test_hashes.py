"""Long words that a polynomial hash modulo 2**64 takes for one: the operators tell them apart."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievestone.llm import decontamination, near_dedup, textops, token_counts, token_output

from .rows import documents, frame

BPE = public_tokenizers.path("byte_bpe_50k.json")


def pair(n: int, letters: str = "ab") -> tuple[str, str]:
    """A Thue-Morse word of n letters and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def rows(n: int) -> list[tuple]:
    texts = [x for letters in ("ab", "xq", "re") for x in pair(n, letters)]
    return [(i, t, "en", "s", len(t), *documents()[0][5:]) for i, t in enumerate(["plain words first", *texts])]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_are_told_apart(spark, tmp_path, n):
    df = frame(spark, rows(n)).coalesce(1)
    library = Tokenizer.from_file(BPE)
    ids = {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in rows(n)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, BPE).collect()} == {k: len(v) for k, v in ids.items()}
    manifest, dictionary = token_output.write_tokens(df, BPE, str(tmp_path / "t"))
    read = {r[0]: r[3] for r in token_output.read_tokens(manifest, dictionary).collect()}
    assert read == {k: zlib.crc32(np.array([*v, 2], "<u4").tobytes()) for k, v in ids.items()}
    near = near_dedup.near_dups(df.select("doc_id", "text"))
    assert all(r["component_id"] == r["doc_id"] for r in near.collect())
    one, two = zip(*[pair(n, x) for x in ("ab", "cd", "ef", "gh", "ij", "kl")], strict=True)
    docs = [(i, f"before {' '.join(words)} after", "en", "s", 1, *documents()[0][5:]) for i, words in enumerate([one, two])]
    items = spark.createDataFrame([(7, " ".join(one))], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.leaks(frame(spark, docs), items).collect()} == {0}


def test_pre_tokens_with_one_first_hash(monkeypatch):
    """Where first hashes agree, the second ones decide: ids and counts stay the library's."""
    hashes = textops.word_hashes
    monkeypatch.setattr("sievestone.llm.pretokens.word_hashes", lambda *a, **k: (hashes(*a, **k)[0] & np.uint64(0xFF), hashes(*a, **k)[1]))
    texts = [f"alpha{i} Beta{i * 7} gamma's δέλτα{i} zz{i}qx" for i in range(60)]
    import pyarrow as pa

    library = Tokenizer.from_file(BPE)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    data, offsets = textops.texts_of(pa.array(texts))
    assert token_counts.ByteLevelCounter(BPE).count(data, offsets).tolist() == [len(w) for w in want]
    encoder = token_output.Encoder(BPE)
    for _ in range(2):
        ids, counts = encoder(data, offsets)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_word_hashes_are_sums_of_placed_bytes():
    words = [b"a", b"b", b"ab", b"ba", b"x" * 64, b"x" * 65, b"xy" * 70, b"yx" * 70]
    data = np.frombuffer(b" ".join(words), np.uint8)
    begin, end, _ = textops.runs(data != 32, np.array([0, len(data)]))
    found = textops.word_hashes(data, begin, end, check=True)
    for values, seed in zip(found, (1, 1 << 40), strict=True):
        for word, value in zip(words, values, strict=True):
            total = textops._placed(np.arange(len(word)), np.frombuffer(word, np.uint8), seed).sum(keepdims=True)
            assert value == textops.mix(total + np.uint64(len(word)))[0]
    assert len({*found[0].tolist(), *found[1].tolist()}) == 2 * len(words)
    assert [len(x) for x in textops.word_hashes(data, begin[:0], end[:0], check=True)] == [0, 0]
