import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsdesk.llm import packing
from opsdesk.llm import textscan as S
from opsdesk.llm.wordbpe import KeySlots, WordBpe

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
ODD = ["", None, "it's DON'T we'll 3,000  a b", "<|endoftext|> foo<|startoftext|>x a<|b", "ÀÉÎÕÜ ß × ÷ naïve", "日本語 text 123 é ́x",
       "a\x00b\x1fc \x85 d", "١٢٣ ½ ²", "İstanbul ΣΑΣ ǅ ﬁ", "'s's 'tis ''", "a b　c", "😀😀 👍🏽!", "Ångstrom", "...---!!! #$% 1a2b3c"]


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(SPEC)


def ids_of(bpe, texts):
    data, off = S.text_bytes(pa.array(texts, pa.string()))
    ids, first = bpe.encode(data, off)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_ids_equal_the_tokenizer(bpe):
    assert ids_of(bpe, ODD) == [bpe.tok.encode(t or "", add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aZé ß'<|1.\n×", max_size=30)), max_size=4))
def test_ids_equal_the_tokenizer_on_any_text(bpe, texts):
    assert ids_of(bpe, texts) == [bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tree_equals_plain_first_fit(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
    fill, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((j for j, f in enumerate(fill) if f + sizes[i] <= 50), len(fill))
        if b == len(fill):
            fill.append(0)
        want[i] = (b, fill[b])
        fill[b] += sizes[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(len(sizes))]


@pytest.mark.parametrize("group", [8, 1 << 14])
def test_pieces_are_exact_and_fit(spark, make_docs, words, bpe, group):
    rows = [(1, None), (2, ""), (3, "hello World"), (3, "hello World"), (None, "x y"), (4, " ".join(words(9000, 1)))]
    rows += [(i, " ".join(words(i * 13 % 700 + 1, i))) for i in range(10, 60)]
    got = packing.pack_documents(make_docs(rows), SPEC, group_pieces=group, emit_ids=True).collect()
    whole = [(i, np.array([*ids, 1], "<u4")) for (i, _), ids in zip(rows, ids_of(bpe, [t for _, t in rows]))]
    want = sorted(((i, a, min(2048, len(x) - a), zlib.crc32(x[a:a + 2048].tobytes()), len(x))
                   for i, x in whole for a in range(0, len(x), 2048)), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark, make_docs):
    assert packing.pack_documents(make_docs([(1, "x")]).where("doc_id = 2"), SPEC).count() == 0


def test_key_slots_equal_a_dictionary():
    rng = np.random.default_rng(1)
    slots, known = KeySlots(), {}
    for _ in range(40):
        keys = np.unique(rng.integers(0, 200_000, 5_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        got = slots.find(keys)
        assert got.tolist() == [known.get(k, -1) for k in keys.tolist()]
        new = keys[got < 0]
        slots.add(new, np.arange(len(known), len(known) + len(new)))
        known.update(zip(new.tolist(), range(len(known), len(known) + len(new))))


def test_the_word_cache_starts_anew_when_full(bpe, words, monkeypatch):
    from opsdesk.llm import wordbpe
    monkeypatch.setattr(wordbpe, "CACHE_WORDS", 50)
    texts = [" ".join(words(120, i)) for i in range(6)]
    assert ids_of(bpe, texts) == [bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for t in texts:
        assert ids_of(bpe, [t]) == [bpe.tok.encode(t, add_special_tokens=False).ids]


def test_memory_is_released_when_a_task_ends():
    from opsdesk.llm.common import releasing
    S.prefix_hash(np.ones(100_000, np.uint64))
    assert len(S._Powers.fwd) > 100_000
    assert list(releasing(lambda batches: iter(batches))([1, 2])) == [1, 2]
    assert len(S._Powers.fwd) == 1
    with pytest.raises(ValueError):
        list(releasing(lambda batches: (_ for _ in ()).throw(ValueError()))([]))
