"""Token ids, packing, token files."""

import zlib

import edges
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagmill.llm import packing, tokenfiles, tokens
from tagmill.storage import fresh_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", "  a b ", " ,x", "\n\ny z\n", "a\tb c\xa0d", "it's 's  x \n q", "　a b", "a\x1cb c", "Σας ΣΑΣ b", "é ́x", "a<|endoftext|> b",
    "tab\t end\n", "x  y z", "a\r\nb c\r\n d", " \n", "\n", "a\0b \0c", "\0x", "İstanbul K b", "THE!! END, (end).", "a <|startoftext|> b", "x" * 300 + " y",
]


def expected(name, texts):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_pieces_encode_like_the_whole(name):
    coder = tokens.Encoder(public_tokenizers.path(name), 2)
    texts = ODD + [r[1] for r in edges.rows()]
    assert coder.kind != "whole"
    for _ in range(2):  # new words, then known ones
        assert coder.encode(texts) == expected(name, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabE.,'!#1é\xa0Σ日\0", max_size=25), max_size=6))
def test_any_text_encodes_like_the_whole(texts):
    for name in FILES:
        assert tokens.encoder(public_tokenizers.path(name), 2).encode(texts) == expected(name, texts)


def test_packing(spark):
    layout = packing.Packing(public_tokenizers.path(FILES[0]), length=64)
    got = packing.pack(edges.table(spark), layout).collect()
    wanted = []
    for row, raw in zip(edges.rows(), expected(FILES[0], [r[1] for r in edges.rows()]), strict=True):
        count = len(raw) // 4
        cuts = ([0] if count % 64 else []) + list(range(count % 64, count, 64))
        for piece, start in enumerate(cuts):
            end = cuts[piece + 1] if piece + 1 < len(cuts) else count
            wanted.append((row[0] or 0, piece, start, end - start, raw[4 * start : 4 * end]))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == sorted(wanted)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    filled: dict = {}
    for row in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == filled.get(row.sequence_id, 0)
        filled[row.sequence_id] = row.offset + row.length
    total = sum(r.length for r in got)
    assert max(filled.values()) <= 64 and len(filled) <= 1 + total // 64 * 1.05
    assert packing.pack(edges.none(spark), layout).count() == 0


def test_text_cut_at_a_time_changes_no_piece(spark):
    layout = packing.Packing(public_tokenizers.path(FILES[0]), length=64)
    docs = edges.table(spark).coalesce(1)
    found = [sorted(map(str, packing.pack(docs, layout._replace(cut_bytes=most)).collect())) for most in (1, layout.cut_bytes)]
    assert found[0] == found[1]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_best_fit_over_counts_places_every_piece(histogram):
    runs = packing.best_fit(histogram, 20)
    used, ranks = {}, set()
    for length, rank, count, first, offset in runs:
        for i in range(count):
            assert (length, rank + i) not in ranks
            ranks.add((length, rank + i))
            used.setdefault(first + i, []).append((offset, length))
    assert ranks == {(length, i) for length, count in histogram.items() for i in range(count)}
    for pieces in used.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 20
    # One piece at a time, longest first, into the fullest sequence that has room.
    room: list = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 20) - length)
    assert len(used) == len(room)


def test_token_files_round_trip(spark):
    layout = tokenfiles.Format(public_tokenizers.path(FILES[1]), length=128)
    folder = fresh_path(spark, "tokens")
    manifest = tokenfiles.write_tokens(edges.table(spark), layout, folder)
    got = sorted(tokenfiles.read_documents(manifest).collect(), key=lambda r: r.start)
    rows = sorted(edges.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, raw, found in zip(rows, expected(FILES[1], [r[1] for r in rows]), got, strict=True):
        assert (found.id, found.start, found.n_tokens, found.ids_crc32) == (row[0], start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    stream = b"".join(expected(FILES[1], [r[1] for r in rows]))
    read = b""
    for file in sorted(manifest.collect(), key=lambda r: r.part):
        sequences = tokenfiles.Sequences(file.path.removeprefix("file://") + ".arrow")
        for i in range(-(-file.n_tokens // 128)):
            ids, mask = sequences[i]
            assert len(ids) == 128 and not ids.flags.writeable
            read += ids[np.array(mask)].astype("<u4").tobytes()
    assert read == stream
    empty = tokenfiles.write_tokens(edges.none(spark), layout)
    assert empty.count() == 0 and tokenfiles.read_documents(empty).count() == 0
