from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlspike.llm import attribution, packing, rans, token_files
from marlspike.llm.common import vocabulary
from marlspike.llm.textvec import TokenEncoder, run_hashes

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, part int, sigs int, length int, z double"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", 1, 1, 1, 1.0) for k, t in enumerate(texts)], SCHEMA)


#: Words of 2,048 letters that polynomial hashes modulo a power of two can't tell apart.
MORSE = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(2048)) for flip in (0, 1)]
ODD = [*MORSE, "", None, " ", "it's a 's 't\n\n  x  \ty 's", "a" * 5000, "Der Straße Σίσυφος İ é 中文 🙂", "<|endoftext|> x", "x\x1cy \xa0z", "12,345.67  'll", "word " * 3000, "dup", "dup"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*"ab cZ'stmdrevl \n\t19.,!éßΣσİ́\x1c’中\x00", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]), max_size=40).map("".join), max_size=6))
def test_encoder_equals_the_library(path, texts):
    own, library = test_encoder_equals_the_library.__dict__.setdefault(path, (TokenEncoder(path), Tokenizer.from_file(path)))
    ids, n = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts] or not texts


def test_run_hashes_tell_structured_runs_apart():
    runs = [x.encode() for x in (*MORSE, "", "a", "aa", "a" * 8, "a" * 9, "a" * 64, "a" * 65, "b" * 64)] + [bytes(k) for k in range(1, 20)]
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(x) for x in runs])
    starts = ends - [len(x) for x in runs]
    both = run_hashes(data, starts, ends, second=True)
    assert all(len(set(h.tolist())) == len(runs) for h in both)
    shifted = run_hashes(np.append(np.uint8(7), data), starts + 1, ends + 1)
    assert shifted.tolist() == both[0].tolist() == run_hashes(data, starts, ends).tolist()


def test_encoder_starts_anew_when_full():
    own, library = TokenEncoder(BYTE, most=50), Tokenizer.from_file(BYTE)
    texts = [" ".join(f"w{k}x{j}" for k in range(30)) for j in range(20)] + [" ".join(f"y{k}" for k in range(200))]
    for _ in range(2):
        for t in texts:
            ids, _ = own.encode([t])
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def naive_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(lengths=st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = packing.plan(counts, 40)
    room = {}
    for length, rank, first, each, offset in sorted(rows.tolist(), key=lambda r: (-r[0], r[1])):
        after = [r for n, r, *_ in rows.tolist() if n == length and r > rank]
        for r in range(rank, min(after, default=counts[length])):
            b, k = first + (r - rank) // each, (r - rank) % each
            assert offset + k * length == 40 - room.get(b, 40)
            room[b] = room.get(b, 40) - length
    assert sorted(room.values()) == naive_best_fit(lengths, 40)


def test_pack(spark):
    library = Tokenizer.from_file(BYTE)
    texts = [*ODD, *(" ".join(random.Random(k).choices(["ab", "the", "x1"], k=k * 7)) for k in range(60))]
    got = packing.pack(frame(spark, texts), BYTE, capacity=256, keep_ids=True).toPandas()
    for k, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == k].sort_values("piece")
        assert b"".join(own.ids) == ids.tobytes() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert (own.length[1:] == 256).all() and len(own) == -(-len(ids) // 256)
        assert own.ids_crc32.tolist() == [zlib.crc32(x) for x in own.ids]
    bins = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (bins.length.sum() <= 256).all() and (bins.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert got.sequence_id.nunique() == len(naive_best_fit(got.length.tolist(), 256))
    assert packing.pack(frame(spark, []), BYTE).count() == 0


@settings(max_examples=100, deadline=None)
@given(ids=st.lists(st.integers(0, 300), max_size=3000), lanes=st.integers(1, 64), every=st.integers(1, 9))
def test_rans_round_trip(ids, lanes, every):
    ids = np.array(ids, np.int64)
    table = rans.Table.of_counts(np.bincount(ids, minlength=301))
    coded, used = rans.encode(ids, table, lanes, every)
    assert rans.decode(coded, len(ids), table).tolist() == ids.tolist()
    points = -(-(-(-len(ids) // used)) // every)
    for k in range(points):
        assert rans.decode(coded, len(ids), table, k).tolist() == ids[k * every * used :].tolist()


def test_rans_checks_its_blocks():
    ids = np.arange(1000) % 7
    table = rans.Table.of_counts(np.bincount(ids))
    block = rans.write_block(ids, [5, None], np.array([400, 600]), 11, table)
    got = rans.read_block(block, table)
    assert got[0].tolist() == ids.tolist() and got[1:2] == ([5, None],) and got[2].tolist() == [400, 600] and got[3] == 11
    for at in (6, 60, len(block) - 3):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.read_block(bytes(bad), table)


def test_token_files(spark):
    library = Tokenizer.from_file(WORD)
    rows = frame(spark, ODD, 3).unionByName(frame(spark, ["late"], 1)).unionByName(spark.createDataFrame([(None, "no id", "en", 1, 1, 1, 1.0)], SCHEMA))
    path = token_files.write_tokens(rows, WORD, block=64)
    got = token_files.read_tokens(spark, path, keep_ids=True).orderBy("start").collect()
    texts = {k + 3: t for k, t in enumerate(ODD)} | {1: "late", None: "no id"}
    assert [r["doc_id"] for r in got] == [None, 1, *range(3, 3 + len(ODD))]
    at = 0
    for r in got:
        ids = np.array(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r["n_tokens"]
    assert token_files.read_tokens(spark, token_files.write_tokens(frame(spark, []), WORD)).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, rule):
    library = Tokenizer.from_file(BYTE)
    texts = [*ODD, "one\ntwo three\n\nfour  \n five\n"]
    got = attribution.section_tokens(frame(spark, texts), BYTE, rule).toPandas()
    for k, t in enumerate(texts):
        t = t or ""
        code = library.encode(t, add_special_tokens=False)
        own = got[got.doc_id == k].sort_values("section")
        bounds = list(zip(own.chars_from, own.chars_to, strict=True))
        assert "".join(t[a:b] for a, b in bounds) == t and own.n_tokens.sum() == len(code.ids)
        want = [0] * len(bounds)
        for a, b in code.offsets:
            share = [max(0, min(b, y) - max(a, x)) for x, y in bounds]
            want[share.index(max(share)) if rule == "majority" else next(i for i, (x, y) in enumerate(bounds) if x <= a < y)] += 1
        assert own.n_tokens.tolist() == want


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rows = spark.createDataFrame([(None, "a b", "en", 1, 1, 1, 1.0), (None, "a b", "en", 1, 1, 1, 1.0), (7, "c d e", "en", 1, 1, 1, 1.0), (7, None, "en", 1, 1, 1, 1.0)], SCHEMA)
    packed = packing.pack(rows, BYTE).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packed) == [(0, 3), (0, 3), (7, 1), (7, 4)] and len({(r["sequence_id"], r["offset"]) for r in packed}) == 4
    counted = attribution.section_tokens(rows, BYTE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in counted) == [(0, 2), (0, 2), (7, 0), (7, 3)]
    assert attribution.section_tokens(frame(spark, []), BYTE).count() == 0
