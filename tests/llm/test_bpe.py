import base64
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

from pagesieve.llm import bpe
from pagesieve.llm.queries import op1_byte_bpe

VOCABULARY = path("byte_bpe_50k.tiktoken")
PIECES = [
    "'", "'s", "'re", "'ve", "'ll", "'t", "'m", "'d", "r", "e", "l", "v", "s", "a", "é", " ", "  ", "\n", "\t",
    " ", "　", "1", "²", "٣", "!", "-", "漢", "\U0001f600", "́", "\x00", "T", "'S", "_", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.load_ranks(VOCABULARY)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(tokenizer):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(5000)]
    for text, ids in zip(texts, bpe.encode_texts(texts, VOCABULARY), strict=True):
        assert ids.tolist() == tokenizer.encode_ordinary(text), text


def test_every_code_point_has_the_class_of_the_pattern(tmp_path):
    """With a merge of each of "a", "1" and "!" with every first byte of a character, the
    ids show which of them a character joins."""
    ranks = {bytes([i]): i for i in range(256)}
    for first in b"a1!":
        for lead in range(256):
            ranks.setdefault(bytes([first, lead]), len(ranks))
    lines = [base64.b64encode(word) + b" %d\n" % rank for word, rank in ranks.items()]
    (tmp_path / "ranks").write_bytes(b"".join(lines))
    small = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} 1{c} !{c}" for c in chars]
    for i in range(0, len(texts), 100_000):
        some = texts[i : i + 100_000]
        got = bpe.encode_texts(some, str(tmp_path / "ranks"))
        assert [x.tolist() for x in got] == small.encode_ordinary_batch(some)


def test_letters_of_new_scripts_before_a_contraction(tokenizer):
    for text in ("\u1c89's", "\ua7cb'll", "\U000105c0's \U00010d40're"):
        assert next(bpe.encode_texts([text], VOCABULARY)).tolist() == tokenizer.encode_ordinary(text)


def test_the_scan_is_the_automaton():
    rng = np.random.default_rng(2)
    maps, _ = bpe.transition_functions()
    for n in (1, 63, 64, 65, 5000):
        functions = rng.integers(0, len(maps), n).astype(np.uint8)
        state, states = 0, []
        for f in functions:
            state = maps[f][state]
            states.append(state)
        assert maps[bpe.scan(functions), 0].tolist() == states


def test_long_pieces_merge_like_short_ones(tokenizer):
    merger = bpe.Merger(bpe.load_ranks(VOCABULARY))
    rng = random.Random(4)
    for n in (2, 10, 60):
        piece = "".join(rng.choice("thaeinor") for _ in range(n)).encode()
        assert merger._merged(piece) == merger._merged_by_heap(piece)
        assert merger._merged_together([piece]) == [np.array(merger._merged(piece), "<u4").tobytes()]
    long = "ab" * 500 + "tion" * 300
    assert next(bpe.encode_texts([long], VOCABULARY)).tolist() == tokenizer.encode_ordinary(long)


def test_encode_and_decode(odd_documents, tokenizer):
    tokens = bpe.encode(odd_documents, VOCABULARY)
    assert tokens.columns[-3:] == ["n_tokens", "ids", "offsets"]
    rows = bpe.decode(tokens, VOCABULARY).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        data = (r.text or "").encode()
        ids = np.frombuffer(r.ids, "<u4")
        assert ids.tolist() == tokenizer.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == data and r.n_tokens == len(ids)
        starts = [*np.frombuffer(r.offsets, "<u4").tolist(), len(data)]
        words = [tokenizer.decode_single_token_bytes(i) for i in ids.tolist()]
        assert words == [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def test_slices_merge_together_like_alone():
    merger = bpe.Merger(bpe.load_ranks(VOCABULARY))
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aeiouthsrn \xc3\xa9") for _ in range(rng.randrange(1, 64))) for _ in range(3000)]
    expected = [np.array(merger._merged(p), "<u4").tobytes() for p in pieces]
    assert merger._merged_together(pieces) == expected
    assert merger.ids(pieces[:50] * 2) == expected[:50] * 2 and merger._merged_together([]) == []


def test_runs_of_tokens_come_back_in_their_place(odd_documents, tokenizer):
    tokens = bpe.encode(odd_documents, VOCABULARY)
    whole = sorted((bytes(r.decoded) for r in bpe.decode(tokens, VOCABULARY, offsets="offsets").collect()))
    assert whole == sorted((r.text or "").encode() for r in odd_documents.collect())
    for first, count in ((0, 3), (2, 5), (10, 100_000), (1, 0)):
        for r in bpe.decode(tokens, VOCABULARY, offsets="offsets", run_of=(first, count)).collect():
            data, ids = (r.text or "").encode(), np.frombuffer(r.ids, "<u4").tolist()
            run = b"".join(map(tokenizer.decode_single_token_bytes, ids[first : first + count]))
            assert bytes(r.decoded) == run
            assert r.begin == (len(tokenizer.decode_bytes(ids[:first])) if run else None)
            assert not run or data[r.begin : r.begin + len(run)] == run
    with pytest.raises(ValueError):
        bpe.decode(tokens, VOCABULARY, run_of=(0, 1))


def test_empty_table(no_documents):
    assert bpe.decode(bpe.encode(no_documents, VOCABULARY), VOCABULARY).collect() == []


def test_query_against_the_library(spark, tokenizer):
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op1_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tokenizer.encode_ordinary(r.text or "")
        row = got.pop(r.doc_id)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got
