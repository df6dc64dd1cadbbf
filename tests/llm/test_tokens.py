import collections
import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from studyloom.llm import bpe, packing, tokenfiles
from studyloom.llm.queries import vocabulary
from studyloom.session import shared_folder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [
    "", "   ", "a  b", "Ab's don't I'LL x", " lead", "trail ", "\n\nx\n y\t\tz", "a \nb", "<|endoftext|> foo<|endoftext|>bar <|startoftext|>",
    "Éá ΣΑΣ naïve\xa0x 　y", "日本語 テスト 123 4五", "x" * 300 + " " + "ab" * 200, "\x1cq \x00 \x85z", "İstanbul ẞ ﬁ", "a\r\nb\r\n",
    "1234 56.78 $$$ ''s 's", "𝔘𝔫𝔦 👍🏽 é", "\n", "\nabc", " \n ", "a\n", "a\xadb <|x|>",
]


def library(name):
    return Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_ids_and_text_equal_the_library(name):
    coder, tok = bpe.Encoder(vocabulary(name)), library(name)
    for text, ids in zip(ODD, coder.encode(ODD)):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert coder.decode(ids).decode() == tok.decode(want, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Encoder(vocabulary(WORD))
    assert [coder.encode([t]) for t in ODD] == [[x] for x in bpe.Encoder(vocabulary(WORD)).encode(ODD)]


def test_digests(make, odd):
    tok = library(WORD)
    rows = odd + [(100 + i, t, None) for i, t in enumerate(ODD)]
    want = collections.Counter()
    for i, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False).encode()
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()] += 1
    got = bpe.digests(make(rows), vocabulary(WORD)).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert bpe.digests(make(rows).limit(0), vocabulary(WORD)).count() == 0
    whole = {r.doc_id: r for r in bpe.encode(make(rows), vocabulary(WORD)).collect()}
    assert whole[3].ids == tok.encode("one two", add_special_tokens=False).ids


def test_bins_hold_no_more_than_a_sequence():
    random = np.random.default_rng(2)
    for lengths in (random.integers(1, 101, 3000), random.integers(30, 60, 500), np.array([100, 100]), np.array([1])):
        bins = packing.best_two_fit(lengths, 100)
        assert sorted(x for b in bins for x in b) == sorted(lengths.tolist())
        assert all(sum(b) <= 100 for b in bins)
    lengths = random.integers(1, 101, 3000)
    assert len(packing.best_two_fit(lengths, 100)) <= 1.02 * lengths.sum() / 100 + 1


def test_two_pieces_replace_the_smallest():
    # greedy takes 60 and 30; 20 + 19 fill the gap of 40 more tightly
    assert sorted(map(sorted, packing.best_two_fit(np.array([60, 30, 20, 19]), 100))) == [[19, 20, 60], [30]]


def test_packing(make, odd):
    tok = library(WORD)
    rows = odd + [(200, "word " * 5000, "en")]
    got = packing.pack(make(rows), vocabulary(WORD)).collect()
    assert packing.pack(make(rows).limit(0), vocabulary(WORD)).count() == 0
    want, sequences = collections.Counter(), collections.defaultdict(list)
    for i, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_ranks_as_bytes():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 5, 7], dtype=np.uint32)
    control, data = tokenfiles.to_bytes(ranks)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 + 1 + 1
    assert (tokenfiles.from_bytes(control, data, len(ranks)) == ranks).all()
    assert len(tokenfiles.from_bytes(b"", b"", 0)) == 0


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_token_files(make, odd, segment, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_TOKENS", segment)
    tok = library(BYTE)
    rows = [r for r in odd if r[0] is not None] + [(None, "q", None), (11, "other text of the same id", "en")]
    got = tokenfiles.round_trip(make(rows), vocabulary(BYTE)).collect()
    at, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert tokenfiles.round_trip(make(rows).limit(0), vocabulary(BYTE)).count() == 0


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_long_runs_without_a_break(name):
    coder, tok = bpe.Encoder(vocabulary(name)), library(name)
    random = np.random.default_rng(4)
    runs = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000)), "ab" * 30_000, "日本語テキスト" * 3000, "x" * 65_537]
    for text in runs:
        begin = time.process_time()
        ids = np.frombuffer(coder.encode([text])[0], "<u4").tolist()
        assert time.process_time() - begin < 6  # a second or less on an idle machine
        assert ids == tok.encode(text, add_special_tokens=False).ids


def test_ranks_are_those_of_the_corpus(spark, make, odd, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_TOKENS", 50)
    tok = library(BYTE)
    folder = shared_folder(spark, "test-tokens")
    tokenfiles.write(make(odd), vocabulary(BYTE), folder)
    counts = collections.Counter(i for _, text, _ in odd for i in tok.encode(text or "", add_special_tokens=False).ids + [0])
    segments, ranked = tokenfiles.read(spark, folder)
    assert ranked.tolist() == sorted(counts, key=lambda i: (-counts[i], i))
    assert segments.count() > 3 and "ranked" not in segments.columns


def test_pieces_are_those_of_the_pattern():
    coder, random = bpe.Encoder(vocabulary(BYTE)), np.random.default_rng(5)
    usual = [*"'stmdrevlla  \n\t\r019AZ.,-<|éßĀ½²×", "'", "'", "'", "'ll", "'re", "'ve", " '", "ɏ"]
    for signs in (usual, [*usual, "ɐ", "日", "\x00", "\xa0", "\xad", "𝔘", "<|endoftext|>"]):
        texts = ["".join(random.choice(signs, n)) for n in random.integers(0, 13, 20_000)] + ["a<", "|b", "it'", "s", "x'l", "l", " ", "y", "", "\n"]
        pieces, first, plain = bpe.cut_bytes(pa.array(texts))
        pieces = pieces.to_pylist()
        assert plain.tolist() == [bool(bpe._FAMILIAR(t)) and "<|" not in t for t in texts]
        assert [pieces[a:b] for a, b in zip(first, first[1:])] == [coder.pattern.findall(t) if own else [] for t, own in zip(texts, plain)]


def test_texts_are_cut_together_and_drafts_are_not_ranked(odd, monkeypatch):
    tok, asked = library(BYTE), []
    texts = [t or "" for _, t, _ in odd if bpe._FAMILIAR(t or "")] * 3
    coder = bpe.Encoder(vocabulary(BYTE))
    numbers = coder._numbers
    monkeypatch.setattr(coder, "_numbers", lambda pieces: asked.extend(pieces) or numbers(pieces))
    monkeypatch.setattr(coder, "_pieces", None)  # one text after another
    monkeypatch.setattr(bpe, "encoder", lambda path: coder)
    monkeypatch.setattr(tokenfiles, "to_bytes", None)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts), "part": pa.array([0] * len(texts), pa.int32())})
    (draft,) = tokenfiles._segments(vocabulary(BYTE), 0)(iter([batch]))
    assert len(asked) == len(set(asked))
    want = [i for t in texts for i in [*tok.encode(t, add_special_tokens=False).ids, 0]]
    assert np.frombuffer(draft.column("ids")[0].as_py(), "<u2").tolist() == want


def test_large_ids_take_four_bytes():
    ids = np.array([5, 70_000, 5], dtype="<u4")
    draft = tokenfiles._draft(0, 0, [1, 2], [ids.tobytes(), ids[:1].tobytes()])
    assert draft.column("ids")[0].as_py() == np.array([5, 70_000, 5, 5], dtype="<u4").tobytes()
    assert np.frombuffer(draft.column("counts")[0].as_py(), "<i8").tolist() == [3, 1]
