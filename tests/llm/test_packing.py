import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing
from graphloom.llm.differencing import multiway_difference, pack_into_windows
from graphloom.llm.tokens import encoder, vocabulary_paths


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_paths()[0])
    found.encode_special_tokens = True
    return found


@given(st.lists(st.integers(1, 100), max_size=40), st.integers(1, 7))
def test_differencing_places_each_item_once(sizes, bins):
    parts = multiway_difference(sizes, bins)
    assert len(parts) == bins
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))


def test_differencing_is_near_equal():
    assert sorted(sum(p) for p in ([[8, 7, 6, 5, 4][i] for i in q] for q in multiway_difference([8, 7, 6, 5, 4], 2))) == [14, 16]
    loads = [sum(range(1, 101)[i] for i in p) for p in multiway_difference(list(range(1, 101)), 4)]
    assert max(loads) - min(loads) <= 2


@given(st.lists(st.integers(1, 50), max_size=30))
def test_windows_hold_their_capacity(sizes):
    windows = pack_into_windows(sizes, 50)
    assert all(sum(sizes[i] for i in w) <= 50 for w in windows)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))


def test_item_larger_than_a_window_is_refused():
    with pytest.raises(ValueError):
        pack_into_windows([51], 50)


@settings(max_examples=300)
@given(st.text(st.sampled_from(list(" \n\t\r\x1c\x85\xa0  ab é漢١1!'s<|>😀")), max_size=20))
def test_chunked_ids_are_the_tokenizers(tokenizer, text):
    got = np.frombuffer(encoder(vocabulary_paths()).encode(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "docs"])
def test_round_trip(request, tokenizer, name):
    df = request.getfixturevalue(name)
    rows = packing.packed_documents(df, digest=True).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in parts]).tolist()
        assert [p.offset for p in parts] == [0, *ends[:-1]] and ends[-1] <= packing.WINDOW
    want = sorted((i, (p.start, p.length, p.ids_crc32)) for i, ps in pieces.items() if i is not None for p in ps)
    have = []
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted({(p.start, p.length) for p in pieces[i] if p.doc_tokens == len(ids)})
        if i is not None:
            assert sum(n for _, n in own) == len(ids) and own[0][0] == 0
            have += [(i, (a, n, zlib.crc32(ids[a : a + n].tobytes()))) for a, n in own]
    assert sorted(have) == want


def test_little_padding_and_stable_reruns(docs):
    rows = packing.packed_documents(docs, digest=True).collect()
    windows = len({r.sequence_id for r in rows})
    assert windows * packing.WINDOW <= 1.03 * sum(r.length for r in rows)
    again = packing.packed_documents(docs.repartition(5), digest=True).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_ids_are_returned_whole(odd_docs, tokenizer):
    rows = packing.packed_documents(odd_docs.where("doc_id = 10")).collect()
    ids = [x for r in sorted(rows, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()]
    assert ids == [*tokenizer.encode("naïve café 漢字 <|endoftext|>", add_special_tokens=False).ids, 1]
