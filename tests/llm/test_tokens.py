import random
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm.packing import fill_windows, least_slack, pack_documents, sequences
from quantloom.llm.token_files import EliasFano, Shard, token_files, write_shard
from quantloom.llm.tokens import PieceEncoder, default_tokenizer

PATH = default_tokenizer()
TOOL = PieceEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aAbZ09'.,!%_ \n\t<|>éÉßœΣσİﬁ́ ")), st.characters(codec="utf-8")), max_size=60))
def test_encoder_equals_library_on_whole_texts(text):
    assert TOOL.by_run
    want = array("I", TOOL.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert TOOL.encode([text], 1)[0][:-4] == want


def test_encoder_joins_new_runs_and_keeps_what_it_needs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéz") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(rng.choice([word(), word().title() + ".", "it's", "ﬁn", "12%", "<|endoftext|>", "x|>", "<|", "\n"]) for _ in range(300)) for _ in range(40)]
    small, calls = PieceEncoder(PATH, limit=1500), []
    library = small.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **more)

        def encode_batch(self, texts, **more):
            calls.extend(texts)
            return library.encode_batch(texts, **more)

    small.tokenizer = Counted()
    for i in range(0, 40, 4):
        assert small.encode(texts[i : i + 4], 1) == [array("I", [*library.encode(t, add_special_tokens=False).ids, 1]).tobytes() for t in texts[i : i + 4]]
    assert len(small.known) <= 1500 and len(calls) < 200  # one by one, over 3000 runs went to the library


def ids_of(text):
    return [*TOOL.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_least_slack_finds_the_best_sum():
    rng = random.Random(1)
    for _ in range(100):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        left = {x: lengths.count(x) for x in lengths}
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        used = least_slack(left, 50)
        assert sum(k * c for k, c in used) == max(s for s in sums if s <= 50)
        assert all(0 < c <= left[k] for k, c in used)


def test_windows_never_overflow_or_overlap():
    lengths = np.random.default_rng(3).integers(1, 129, 500)
    window, offset = fill_windows(lengths, 128)
    for w in set(window):
        inside = sorted((offset[i], lengths[i]) for i in np.flatnonzero(window == w))
        at = 0
        for o, n in inside:
            assert o == at
            at += n
        assert at <= 128


def test_packing_holds_every_id_once(spark, odd):
    packed = pack_documents(odd, PATH, capacity=256).toPandas()
    for r in odd.select("doc_id", "text").collect():
        ids, mine = ids_of(r["text"]), packed[packed["doc_id"] == r["doc_id"]].sort_values("start")
        assert mine["length"].sum() == len(ids) and (mine["doc_tokens"] == len(ids)).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    ends = packed.groupby("sequence_id").apply(lambda g: (sorted(zip(g["offset"], g["length"]))), include_groups=False)
    assert all(sum(n for _, n in s) <= 256 and s[0][0] == 0 for s in ends)
    got = sequences(odd, spark.createDataFrame(packed), PATH).toPandas()
    assert sum(map(len, got["ids"])) == packed["length"].sum()


def test_packing_of_nothing(none):
    assert pack_documents(none, PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded, _ = EliasFano.from_bytes(memoryview(EliasFano.encode(np.array(values, np.uint64)).to_bytes()))
    n = len(values)
    assert coded.select_range(0, n).tolist() == values and [coded.select(i) for i in range(n)] == values
    for first, stop in ((0, n // 2), (n // 3, n), (n // 2, n // 2)):
        assert coded.select_range(first, stop - first).tolist() == values[first:stop]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.encode(ends).to_bytes()) * 8 < 10_000 * (2.5 + np.log2(ends[-1] / 10_000))


def test_shard_round_trip():
    docs, ids = [None, -5, 7, 7], [[3, 1], [1], [9, 9, 1], [40_000, 1]]
    for wide in (False, True):
        shard = Shard(write_shard(docs, [np.array(x, "<u4").tobytes() for x in ids], wide))
        assert [d for i in range(4) for d in shard.doc_ids(i, 1)] == docs == shard.doc_ids(0, 4) and shard.starts(0, 4).tolist() == [shard.start(i) for i in range(4)] + [8] and [shard.tokens(i).tolist() for i in range(4)] == ids


def test_token_files_hold_every_document_in_order(odd):
    got, at = token_files(odd, PATH).orderBy("doc_id").collect(), 0
    for r, want in zip(got, odd.orderBy("doc_id").collect(), strict=True):
        ids = ids_of(want["text"])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want["doc_id"], at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_take_repeated_and_null_ids(spark):
    rows = [(3, "c"), (None, "n"), (3, "c c"), (None, None), (1, "a"), (3, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS start", "'x' AS file")
    got = token_files(frame, PATH).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3, 3]
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == sorted((d or 0, crc(ids_of(t))) for d, t in rows)
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(6)]
    packed = pack_documents(frame, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in packed) == sorted((d or 0, crc(ids_of(t))) for d, t in rows)


def test_long_shards_are_read_in_parts():
    docs, ids = list(range(-50, 3000)), [np.arange(1 + i % 5, dtype="<u4") for i in range(3050)]
    shard = Shard(write_shard(docs, [x.tobytes() for x in ids], True))
    assert len(shard) == 3050 and shard.doc_ids(1000, 1500) == docs[1000:2500]
    assert shard.starts(1000, 1500).tolist() == np.cumsum([0, *map(len, ids)])[1000:2501].tolist()
    assert all((shard.tokens(i) == ids[i]).all() for i in range(0, 3050, 97))


def test_token_files_of_nothing(none):
    assert token_files(none, PATH).count() == 0


@pytest.fixture(autouse=True)
def seeded():
    random.seed(0)
