"""Token files, byte-pair codec and token counts against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from storyweft.llm import bpe_codec, byte_pairs, pretokens, token_counts, token_files

TEXTS = [None, "", " ", "  \n\n a", "I'll say it's 12345 ok?!  'sabc \t'", "x" * 3000, "word " * 40_000, "naïve café 中文　字 😀 ²", "a<|endoftext|> b<|endoftext|>", "same", "same", "it's'll're'd ''s\n's"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 10, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(None, "no id", "c", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, block int").repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def texts():
    return {**{k * 10: t or "" for k, t in enumerate(TEXTS)}, None: "no id"}


def test_pretokens_against_the_pattern():
    import random

    import regex

    rng = random.Random(4)
    letters = "ab'stmdrevl 12  \n\t.,!é中 　'’😀²"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    raw = [t.encode() for t in some]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, _, counts = pretokens.boundaries(data, offsets)
    got = pretokens.slices(data, starts)
    for i, t in enumerate(some):
        assert got[counts[i] : counts[i + 1]] == [x.encode() for x in regex.findall(P.PATTERN, t)]


def test_codec_equals_tiktoken_and_round_trips(spark, docs):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_pairs.ranks_of(byte_pairs.default_ranks()), special_tokens={})
    got = {r.doc_id: r for r in bpe_codec.digests(docs).collect()}
    assert set(got) == set(texts())
    for key, text in texts().items():
        ids = np.array(own.encode_ordinary(text), "<u4")
        assert got[key].n_tokens == len(ids) and got[key].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe_codec.encode(docs)
    for r in encoded.collect():
        raw = texts()[r.doc_id].encode()
        assert b"".join(raw[a:b] for a, b in zip([0, *r.token_ends], r.token_ends)) == raw
    assert {r.doc_id: bytes(r.data) for r in bpe_codec.decode(encoded).collect()} == {k: t.encode() for k, t in texts().items()}


def test_counts_equal_the_library(docs, library):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    for key, text in texts().items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[key].n_tokens, got[key].n_bytes, got[key].over_limit) == (n, len(text.encode()), n > 512)


def test_transducer_on_random_words(library):
    rng = np.random.default_rng(1)
    machine = token_counts.Transducer(*byte_pairs.vocabulary_of(byte_pairs.default_json()))
    words = ["".join(rng.choice([*"etaoinshrdlucmfwypvbgkqjxz"], rng.integers(1, 25))) for _ in range(400)]
    ends = np.cumsum([len(w) for w in words])
    got = machine.count(np.frombuffer("".join(words).encode(), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert got.tolist() == [len(library.encode(w).ids) for w in words]


@pytest.mark.parametrize("most", [1, 50, 2000])
def test_states_are_bounded_inside_a_call(library, monkeypatch, most):
    monkeypatch.setattr(token_counts, "MAX_STATES", most)
    monkeypatch.setattr(token_counts, "SLICES", 30)
    rng = np.random.default_rng(5)
    machine = token_counts.Transducer(*byte_pairs.vocabulary_of(byte_pairs.default_json()))
    words = ["".join(rng.choice([*"etaoinshrdluxyz"], n)) for n in [*rng.integers(1, 30, 100), 6000]]
    ends = np.cumsum([len(w) for w in words])
    got = machine.count(np.frombuffer("".join(words).encode(), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert got.tolist() == [len(library.encode(w).ids) for w in words]
    assert len(machine.states) <= most + 2 * 30 * 2 and len(machine.next) <= 1024 + 16384


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHE_BYTES", 1000)
    for kind in (byte_pairs.WordCache, byte_pairs.CountCache):
        of = len if kind is byte_pairs.CountCache else lambda w: b"<" + w
        cache = kind(lambda words: [*map(of, words)])
        for k in range(50):
            words = [b"%d" % (k * 10 + j) for j in range(10)] + [b"x" * 5000, b"0"]
            assert [*cache.of(words)] == [*map(of, words)]
            assert len(cache) <= 20 and b"x" * 5000 not in cache


def test_long_merge_equals_short(library):
    ranks = byte_pairs.ranks_of(byte_pairs.default_ranks())
    rank_of = lambda a, b: ranks.get(a + b)
    word = b"thereisnothinglikeaverylongword" * 6
    assert byte_pairs._merge_long([word[i : i + 1] for i in range(len(word))], rank_of) == byte_pairs.merge(word, rank_of)


def test_files_read_back(spark, docs, library, tmp_path):
    folder = f"file://{tmp_path}/ids"
    files = token_files.write(docs, folder)
    got = sorted(token_files.read(files, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *(k * 10 for k in range(len(TEXTS)))]
    start = 0
    for r in got:
        ids = np.array([*library.encode(texts()[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_blocks_of_wide_ranks():
    import io

    rng = np.random.default_rng(2)
    ids = rng.permutation(np.arange(70_000)).astype(np.uint32)
    packed = token_files.pack_block(np.array([5, 6]), np.array([69_000, 1000]), ids)
    (keys, sizes, back), = token_files.unpack_blocks(io.BytesIO(packed))
    assert keys.tolist() == [5, 6] and sizes.tolist() == [69_000, 1000] and (back == ids).all()


def test_blocks_are_encoded_in_steps(library, monkeypatch):
    rng, seen = np.random.default_rng(8), []
    whole = [" ".join(rng.choice(["tree", "river", "naïve", "12", "<|endoftext|>", "zq"], n)) for n in rng.integers(0, 20_000, 60)]
    raw = [t.encode() for t in whole]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([*map(len, raw)])])
    plain = pretokens.boundaries
    monkeypatch.setattr(pretokens, "boundaries", lambda d, o: seen.append(len(d)) or plain(d, o))
    got = [*token_files.encode_block(data, offsets, P.path("byte_bpe_50k.json"))]
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in whole]
    assert len(data) > 2 << 20 and sum(seen) == len(data) and max(seen) <= 1 << 20


@pytest.mark.parametrize("most, slots", [(1 << 20, None), (50, None), (1 << 20, lambda table, one, two: np.full(len(one), len(table.rows) - 2))])
def test_table_of_ids_against_a_plain_one(monkeypatch, most, slots):
    import random

    if slots:  # every pre-token has the same place
        monkeypatch.setattr(byte_pairs.IdTable, "_slots", slots)
    ids_of = lambda w: [zlib.crc32(w) & 0xFFFF, *w][: 1 + len(w) % 7] if w[0] != 1 else []
    asked, rng = [], random.Random(9)
    table = byte_pairs.IdTable(lambda words: asked.extend(words) or [np.array(ids_of(w), np.uint32).tobytes() for w in words], most=most)
    for n in (0, 1, 40, 300, 300):
        words = [bytes(rng.choice((0, 1, 97, 195, 255)) for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 14, 15, 16, 17, 40, 300)))) for _ in range(n)]
        words += [b"ab", b"ab\0", b"a" * 15, b"a" * 16, b"ab"] * (n > 1)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        ids, number = table.of(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(words)], ends)
        assert ids.tolist() == [i for w in words for i in ids_of(w)] and number.tolist() == [len(ids_of(w)) for w in words]
    short = [w for w in asked if len(w) <= 15]
    assert (most < 100) == (len(short) > len({*short}))  # asked once, unless the table began anew
    assert 2 * table.n <= len(table.rows) and table.n < most + 310


def test_short_pretokens_are_looked_up_without_objects(library, monkeypatch):
    looked, plain = [], byte_pairs.WordCache.of
    monkeypatch.setattr(byte_pairs.WordCache, "of", lambda self, words: looked.extend(words) or plain(self, words))
    text = "the tree by a river, " * 500 + "x" * 40 + " averyveryverylongword"
    data = np.frombuffer(text.encode(), np.uint8)
    for _ in range(2):
        got, = token_files.encode_texts(data, np.array([0, len(data)]), P.path("byte_bpe_50k.json"))
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted({*looked}) == [b" averyveryverylongword", b" " + b"x" * 40]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    folder = f"file://{tmp_path}/none"
    assert token_files.read(token_files.write(none, folder), folder).count() == 0
    assert bpe_codec.digests(none).count() == token_counts.count_tokens(none).count() == 0
