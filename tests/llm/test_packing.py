import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldspark.llm.packing import CAPACITY, Encoder, pack, plan, tokenizer_file

from .data import edge_texts, frame, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    blanks = ["a", "b", " ", " ", "\n", "\t", "'s", "1", ".", "é", "\x0b", "\xa0", "　", "\x1f", "\x85", " ", "\0"]
    texts = ["", " ", "  ", "don't  stop", "<|endoftext|> z", "hello<|endoftext|>", "a <|endoftext|> <|endoftext|>b  c", "<|endoftext|", "<|endoftext|>" * 3 + " x"] + ["".join(rng.choice(blanks) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, Encoder(tokenizer_file()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_have_their_ids(spark, tokenizer):
    docs = [(1, "hello<|endoftext|>"), (2, "x " * 3000 + "<|endoftext|> y"), (3, "plain")]
    got = defaultdict(list)
    for r in sorted(pack(frame(spark, docs), with_ids=True).collect(), key=lambda r: r.piece):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got[1] == [31373, 50256, 0]
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in docs}


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_gapless_and_whole(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64, 2048])
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 40)))}
    slots, used = set(), defaultdict(list)
    for length, rank, n, first, offset in plan(counts, capacity):
        for i in range(n):
            assert (length, rank + i) not in slots
            slots.add((length, rank + i))
            used[first + i].append((offset, length))
    assert slots == {(n, i) for n, c in counts.items() for i in range(c)}
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_pieces_rebuild_documents(spark, tokenizer):
    docs = [(r[0], r[1]) for r in rows(spark)] + [(1000 + i, t) for i, t in enumerate(edge_texts())]
    got = pack(frame(spark, docs).repartition(3), with_ids=True).collect()
    ids, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = np.frombuffer(r.ids, "<u4")
        assert len(own) == r.length <= CAPACITY and zlib.crc32(r.ids) == r.ids_crc32
        ids[r.doc_id].append((r.piece, r.start, own.tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in docs:
        whole = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(ids[i])
        assert [p[0] for p in parts] == list(range(-(-len(whole) // CAPACITY)))
        assert sum((p[2] for p in parts), []) == whole
        assert [p[1] for p in parts] == [sum(len(q[2]) for q in parts[:k]) for k in range(len(parts))]
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= CAPACITY
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // CAPACITY) + 1


def test_repeated_rows_nulls_and_an_empty_table(spark):
    got = pack(frame(spark, [(1, "same"), (1, "same"), (None, None)])).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert pack(frame(spark, []).limit(0)).count() == 0
