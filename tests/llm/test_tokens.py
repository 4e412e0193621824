import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from swarmlake.llm import monoid_bpe, packing, rans, scratch
from swarmlake.llm.tokens import PartEncoder


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_part_encoder(tokenizers_at):
    path = tokenizers_at.path("byte_bpe_50k.json")
    whole, parts = library(path), PartEncoder(path, limit=50)
    rng = random.Random(3)
    letters = "ab'srtvelm 12\n\t\r\x01\x1c\x85 　日é!,.  '"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "\n", "a  b", "<|endoftext|>", "end ", " \n x"]
    texts += ["x <|endoftext|> y", "x<|endoftext|><|endoftext|>", "<|endoftext|> a<|endoftext|", "\n<|endoftext|>\n\x01<|endoftext|>  b", "<|endoftex<|endoftext|>t|>"]
    for some in (texts, texts[::-1]):
        ids, n = parts.encode(pa.array(some))
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [whole(t) for t in some]


def test_parts_that_return_are_kept(tokenizers_at, monkeypatch):
    """Over the limit, parts of the texts at hand stay known, so only new ones go to the library; ids are the same."""
    path = tokenizers_at.path("byte_bpe_50k.json")
    encoder, learned = PartEncoder(path, limit=60), []
    plain = encoder.library
    monkeypatch.setattr(encoder, "_learn", lambda keys, learn=encoder._learn: (learned.extend(keys), learn(keys))[1])
    often = " ".join(f"common{i}" for i in range(30))
    for k in range(6):
        texts = [often + "".join(f" rare{k}x{i}" for i in range(20)), "", f"first{k} common3\ncommon4, it's"]
        ids, counts = encoder.encode(pa.array(texts))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert learned.count("common7") == 1 and learned.count("rare0x3") == 1


def test_other_tokenizers_are_refused(tokenizers_at, tmp_path):
    import json

    with open(tokenizers_at.path("byte_bpe_50k.json")) as f:
        settings = json.load(f)
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(settings | change))
        with pytest.raises(ValueError, match="byte-level"):
            PartEncoder(str(path))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing(docs, edge, tokenizers_at):
    path = tokenizers_at.path("byte_bpe_50k.json")
    whole = library(path)
    rows = packing.pack(docs(edge), path).collect()
    want = []
    for i, t in edge:
        ids = [*whole(t), 0]
        stop = len(ids) % 2048 or min(len(ids), 2048)
        start, k = 0, 0
        while start < len(ids):
            want.append((i, k, start, stop - start, crc(ids[start:stop])))
            start, stop, k = stop, stop + 2048, k + 1
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs([]), path).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    sizes, n = np.unique(np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048), return_counts=True)
    h = dict(zip(sizes.tolist(), n.tolist()))
    runs = packing.plan_runs(h, 2048)
    made = {}
    for size, first, each, count, _, offset in runs:
        assert made.get(size, 0) == first and offset + each * size <= 2048
        made[size] = first + each * count
    assert made == h
    assert max(r[4] + r[3] for r in runs) <= 1.02 * sum(k * v for k, v in h.items()) / 2048 + 1


def test_token_files(spark, docs, edge, tokenizers_at):
    path = tokenizers_at.path("byte_bpe_50k.json")
    whole = library(path)
    out = scratch.new_path(spark, "test-rans")
    rows = rans.read(spark, rans.write(docs(edge), path, out)).collect()
    order = sorted(edge, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t in order:
        ids = [*whole(t), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])
    assert got == want
    assert rans.read(spark, rans.write(docs([]), path, scratch.new_path(spark, "test-rans"))).count() == 0


def test_token_files_of_split_ranges(spark, docs, tokenizers_at):
    """A range whose rows many tasks read back still gives each document a place of its own."""
    path = tokenizers_at.path("byte_bpe_50k.json")
    rng = random.Random(5)
    rows = [(7 if i % 3 else i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(1500)]
    small = {"parquet.block.size": "8192", "spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        out = rans.write(docs(rows), path, scratch.new_path(spark, "test-rans"))
        assert spark.read.parquet(f"{out}/blocks").count() > 8
        got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in rans.read(spark, out).collect())
    finally:
        for k in small:
            spark.conf.unset(k)
    assert [s for s, _, _ in got] == np.cumsum([0, *(n for _, n, _ in got[:-1])]).tolist()
    assert [i for _, _, i in got] == sorted(i for i, _ in rows)


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    for n, lanes in ((1, 4), (5, 4), (10_000, 64), (4096, 64)):
        ids = np.minimum(rng.geometric(0.01, n) - 1, 999)
        coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=1000)))
        states, words = coder.encode(ids, lanes)
        assert (coder.decode(n, states, words) == ids).all()


def test_patterns_that_run_over_cuts_are_refused(tokenizers_at):
    monoid_bpe.check_places(tokenizers_at.PATTERN)
    for pattern in (r"\S+\s*|\s+", r"[\s\S]", r"\w+!|[\s\S]+?"):
        if pattern == r"[\s\S]":
            monoid_bpe.check_places(pattern)  # every character is a match
            continue
        with pytest.raises(ValueError, match="split pattern"):
            monoid_bpe.check_places(pattern)


def test_monoid_bpe(docs, edge, tokenizers_at):
    path, pattern = tokenizers_at.path("byte_bpe_50k.tiktoken"), tokenizers_at.PATTERN
    small = monoid_bpe.TreeCodec(path, pattern, leaf=4, window=2)
    rng = random.Random(1)
    letters = "ab'srtvelldm 12\n\t\r\x1c\x85 　日é!,.  '"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert small.encode(t) == small.plain.encode_ordinary(t)
    encoded = monoid_bpe.encode_texts(docs(edge), path, pattern)
    for r, (i, t) in zip(sorted(encoded.collect(), key=lambda r: (r["doc_id"] or 0, r["n_tokens"])), sorted(edge, key=lambda e: (e[0] or 0, len(small.plain.encode_ordinary(e[1] or ""))))):
        ids = small.plain.encode_ordinary(t or "")
        assert (r["doc_id"], r["n_tokens"]) == (i, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {bytes(r["data"]) for r in monoid_bpe.decode_ids(encoded, path, pattern).collect()}
    assert back == {(t or "").encode() for _, t in edge}
    assert monoid_bpe.encode_texts(docs([]), path, pattern).count() == 0
