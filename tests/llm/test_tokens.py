import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from crossmer.llm import lengths, packing, seekable
from crossmer.llm.tokens import TokenEncoder, default_tokenizer
from crossmer.operators.storage import new_path
from tests.llm.texts import frame, odd, prose


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_plain_tokenizer(plain):
    texts = ["", "a  b\n\tc", "Don't STOP, it's 3.5% of ß/É.", "İ Σς ΑΣ. x\u0301y e\u0301", "<|endoftext|> <|ENDOFTEXT|>",
             "a\x1cb\x85c\u00a0d", "ª º µ ×÷ naïve.,.", ".,", "x" * 3000, prose(1, 500), "日本語 テキスト", "\r\n"]
    encode = TokenEncoder(default_tokenizer()).encode
    for text, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, plain):
    documents = odd(spark)
    manifest = seekable.write_token_files(documents, new_path(spark, "token-ids"))
    rows = seekable.read_token_files(manifest).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    expected = sorted(documents.collect(), key=lambda r: key(r))
    start, got = 0, sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in expected]
    by_id = {}
    for row in got:
        assert row["start"] == start and row["n_tokens"] == len(row["ids"])
        start += row["n_tokens"]
        by_id.setdefault(row["doc_id"], []).append(row["ids"])
    for number in {r["doc_id"] for r in expected}:
        want = sorted(ids_of(plain, r["text"]) for r in expected if r["doc_id"] == number)
        assert sorted(by_id[number]) == want
    for row in seekable.read_digests(manifest).collect():
        assert row["ids_crc32"] in {zlib.crc32(struct.pack(f"<{len(i)}I", *i)) for i in by_id[row["doc_id"]]}
    wanted = spark.createDataFrame([(4,), (9,), (9,), (77,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in seekable.read_documents(manifest, wanted).collect()}
    assert found == {n: by_id[n][0] for n in (4, 9)}


def test_damage_is_noticed(tmp_path):
    path = str(tmp_path / "one.zst")
    writer = seekable.FrameWriter(path)
    for n in range(3):
        writer.add(n, struct.pack("<2I", n, 7))
    writer.close()
    reader = seekable.FrameReader(path)
    assert reader.frame(1) == struct.pack("<2I", 1, 7) and reader.documents.tolist() == [0, 1, 2]
    data = bytearray(open(path, "rb").read())
    data[12] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        seekable.FrameReader(path).frames(0, 3)
    open(path, "wb").write(data[:-1])
    with pytest.raises(seekable.DamagedFrame):
        seekable.FrameReader(path)


def test_no_documents(spark):
    none = frame(spark, [])
    manifest = seekable.write_token_files(none, new_path(spark, "token-ids"))
    assert manifest.count() == 0 and seekable.read_digests(manifest).count() == 0
    assert lengths.suffix_sums(lengths.histogram(lengths.token_lengths(none))).count() == 0
    assert packing.pack_documents(none).count() == 0


def test_lengths_against_brute_force(spark, plain):
    documents = odd(spark)
    own = [len(ids_of(plain, r["text"])) for r in documents.collect()]
    sums = lengths.suffix_sums(lengths.histogram(lengths.token_lengths(documents)))
    rows = {r["length"]: r for r in sums.collect()}
    assert set(rows) == set(own)
    for limit, row in rows.items():
        assert row["n_docs"] == own.count(limit)
        assert row["docs_longer"] == sum(n > limit for n in own)
        assert row["truncated_total"] == sum(min(n, limit) for n in own)
        assert row["tokens_lost"] == sum(max(0, n - limit) for n in own)
    for row in lengths.at_limits(sums, [0, 1, 3, 50, 10**6]).collect():
        c = row["context_limit"]
        assert (row["docs_longer"], row["truncated_total"]) == (sum(n > c for n in own), sum(min(n, c) for n in own))
    got = {r["share"]: r["length"] for r in lengths.quantiles(sums, [0.5, 1.0]).collect()}
    assert got == {0.5: sorted(own)[(len(own) + 1) // 2 - 1], 1.0: max(own)}


def check_packing(rows, capacity):
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing_places_every_piece(spark, plain):
    documents = odd(spark)
    rows = packing.pack_documents(documents, 256).collect()
    expected = []
    for r in documents.collect():
        ids = ids_of(plain, r["text"])
        for k in range(0, len(ids), 256):
            part = ids[k:k + 256]
            expected.append((r["doc_id"], k // 256, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    order = lambda t: (t[0] is not None, t)
    assert sorted(got, key=lambda t: str(order(t))) == sorted(expected, key=lambda t: str(order(t)))
    assert check_packing(rows, 256) == -(-sum(e[3] for e in expected) // 256)


@pytest.mark.parametrize("seed,n", [(1, 300), (2, 60_000)])
def test_solution_is_close_to_the_bound(seed, n):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(512, rng.lognormal(4.5, 1.0, n).astype(int) + 1)
    counts = np.bincount(sizes, minlength=513)
    plan = packing.solve(counts, 512)
    got = np.zeros(513, dtype=int)
    for config, times in plan:
        assert sum(config) <= 512
        np.add.at(got, list(config), times)
    assert (got == counts).all()
    bound = -(-int(sizes.sum()) // 512)
    assert sum(t for _, t in plan) <= bound + 1 + bound // 500


@pytest.mark.parametrize("n", [300, 1_000, 60_000])
def test_the_program_places_sequences_at_every_size(n):
    rng = np.random.default_rng(n)
    counts = np.bincount(np.minimum(511, rng.lognormal(4.5, 1.0, n).astype(int) + 1), minlength=513)
    left = counts.copy()
    bound = -(-int((counts * np.arange(513)).sum()) // 512)
    plan = packing.place_by_program(left, 512, packing._rest(left, 512))
    assert sum(times for _, times in plan) >= 0.25 * bound
    assert all(sum(config) == 512 for config, _ in plan)
    assert sum(times for _, times in packing.solve(counts, 512)) <= 1.01 * bound + 1


def test_ranks_of_a_hot_length_are_split(spark):
    """Repeated rows of one document are numbered by as many tasks as have written them."""
    cut = spark.range(0, 1000, 1, 8).selectExpr("7L doc_id", "0 piece", "0L start", "7L length", "1L ids_crc32", "spark_partition_id() slice")
    got = packing.ranked(cut).collect()
    assert sorted(r["rank"] for r in got) == list(range(1000))
    assert len({r["slice"] for r in got}) == 8
