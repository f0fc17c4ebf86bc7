"""Row-wise operators: BPE, quality rules, secrets, token counts, media."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import odd_rows
from harness import DATA, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sextant.llm import bpe, mpeg, quality, secrets, token_counts
from sextant.llm._shared import slices

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER, DECODER = bpe.Encoder(bpe.default_vocabulary()), bpe.Decoder(bpe.default_vocabulary())


def library(texts):
    return [x.ids for x in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
def test_bpe_is_the_library(texts):
    got = ENCODER(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(texts)
    assert DECODER(got) == TOKENIZER.decode_batch(library(texts), skip_special_tokens=False) == texts


def test_bpe_of_every_token_and_long_words():
    texts = [b.decode("utf-8", "ignore") for b in ENCODER.vocabulary.bytes] + ["ab" * 2000, "é" * 700, " " * 900, "a\x00", "a"]
    texts += ["x" * n for n in (255, 256, 257, 258, 300, 40_000)] + ["x" * 300 + "y", "x" * 400 + "\x00", "z" * 256 + "\x00", "z" * 256]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)] == library(texts)


def test_op2_on_a_table(spark):
    got = {r.doc_id: r for r in bpe.op2_bpe_round_trip(spark, DATA).collect()}
    for d, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(library([t])[0], "<u4")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_on_odd_rows(odd, empty):
    rows = bpe.decode(bpe.encode(odd), keep=("doc_id", "n_tokens")).collect()
    assert sorted(r.text for r in rows) == sorted(t or "" for _, t, *_ in odd_rows())
    both = bpe.round_trip(odd).collect()
    assert Counter((r.doc_id, r.n_tokens, r.text) for r in both) == Counter((r.doc_id, r.n_tokens, r.text) for r in bpe.decode(bpe.encode(odd), keep=("doc_id", "n_tokens")).collect())
    assert bpe.encode(empty).count() == 0 == bpe.round_trip(empty).count()


def test_quality_sql(spark):
    assert not difference(spark, "op3", quality.op3_quality_rules, quality.SQL["op3_quality_rules"])


def test_quality_keeps_prose_and_drops_junk(odd, empty):
    rows = {r.doc_id: r for r in quality.assess(odd).collect()}
    assert rows[1].kept and rows[4].kept
    assert not any(rows[i].kept for i in (5, 6, 7, 8, 14))
    assert rows[12].base_failed  # one word over and over
    junk = "\n".join(["Thnd*** iner*** ther*** that***" for _ in range(30)])
    assert quality.judge(junk)[6] is False and quality.judge("All rights reserved.\n" + rows[1].clean_text)[10] == rows[1].clean_text
    assert quality.assess(empty).count() == 0


def brute_secrets(text):
    rules = (
        ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    )
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= n]
    return [(name, s, e) for s, _, name, e in sorted(found)]


def test_secrets_are_the_rules():
    random.seed(5)
    pieces = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "'", '"', " ", ":", "=", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "日", "\n", "/", "x", "ghp_", "eyJ"]
    for _ in range(5000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(1, 14)))
        assert [s for s in secrets.spans(text) if s[0] in ("assign", "access", "hex")] == brute_secrets(text)


def test_secret_query_and_more_rules(spark, odd, empty):
    assert ("github", 2, 42) in secrets.spans("é ghp_" + "a1B2" * 9)
    assert secrets.spans("-----BEGIN RSA PRIVATE KEY-----")[0][0] == "private_key"
    rows = secrets.op6_secret_scan(spark, DATA).collect()
    texts = {d: t for d, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_secrets(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert secrets.scan_secrets(odd).count() == odd.count() and secrets.scan_secrets(empty).count() == 0
    assert secrets.redact(odd).where("text is null").count() == 1


def test_automaton_is_minimal_and_small():
    _, transitions, accepts, first = secrets._automaton(True)
    assert len(transitions) // 256 < 1000 and all(s >= first for s in accepts)


def test_token_counts(spark, odd, empty):
    lengths = sorted(r[0] for r in bpe.encode(spark.read.parquet(f"{DATA}/documents.parquet"), keep=(), ids=False).collect())
    summed = token_counts.op7_token_counts(spark, DATA)
    for r in summed.collect():
        assert r.docs_up_to == sum(x <= r.length for x in lengths) and r.tokens_cut == sum(min(x, r.length) for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.length)
    limits = [0, 1, 77, 1000, 10**6]
    got = {r.limit: (r.docs_longer, r.tokens_cut) for r in token_counts.at_limits(summed, spark.createDataFrame([(x,) for x in limits], "limit long")).collect()}
    assert got == {x: (sum(y > x for y in lengths), sum(min(x, y) for y in lengths)) for x in limits}
    assert token_counts.quantile(summed, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.sums(token_counts.histogram(odd)).agg({"n_docs": "sum"}).first()[0] == odd.count()
    assert token_counts.sums(token_counts.histogram(empty)).count() == 0


def test_media_round_trip_and_damage(spark, odd, empty):
    assert mpeg.crc16(b"123456789") == 0xAEE7
    random.seed(2)
    for n in (0, 1, 191, 192, 193, 767, 769, 5000):
        payload = mpeg.pad(random.randbytes(n))
        stored = mpeg.store(payload)
        s = mpeg.Stream(stored)
        assert mpeg.read_back(stored, s) == payload and not s.failed and not s.skipped and s.checked == len(s.frames) == s.table[0]
        assert s.n_samples == 1152 * len(s.frames) and s.rate == 48000
    broken = bytearray(mpeg.store(mpeg.pad(b"y" * 4000)))
    at = mpeg.Stream(bytes(broken)).frames[2][0]
    broken[at + 10] ^= 1
    assert mpeg.Stream(bytes(broken)).failed == 1
    joined = bytes(broken[:at]) + b"junk\xff\xe0\xff" + bytes(broken[at:])  # a stored stream ends with a tag of its own
    s = mpeg.Stream(joined)
    assert s.skipped == 7 and s.tags == 2 and len(s.frames) == len(mpeg.Stream(bytes(broken)).frames)
    texts = {d: t for d, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in mpeg.op8_mpeg_media(spark, DATA).collect():
        p = mpeg.pad(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert mpeg.parse(mpeg.encode(odd)).count() == odd.count() and mpeg.parse(mpeg.encode(empty)).count() == 0


def test_slices_hold_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["t"])
    assert sum((x.column(0).to_pylist() for x in slices(batch, 0, 50)), []) == batch.column(0).to_pylist()


def test_media_keeps_texts_that_look_like_tags():
    for units in (1, 2, 3, 4, 5, 7, 8):
        for at in range(mpeg.UNIT - 3):
            payload = bytearray(b" " * (units * mpeg.UNIT))
            payload[-mpeg.UNIT + at : -mpeg.UNIT + at + 3] = b"TAG"
            stored = mpeg.store(bytes(payload))
            s = mpeg.Stream(stored)
            assert mpeg.read_back(stored, s) == payload and s.tags == 2 and not s.skipped


def test_media_reads_streams_from_elsewhere(spark):
    frame = bytes([0xFF, 0xFB, 0x90, 0xC0]) + bytes(413)  # 128 kbit/s at 44.1 kHz: 417 bytes
    df = spark.createDataFrame([(1, frame * 5), (2, b"TAG" + bytes(125)), (3, None)], "doc_id long, media binary")
    got = {r.doc_id: (r.n_frames, bytes(r.payload), r.n_tags) for r in mpeg.parse(df).collect()}
    assert got == {1: (5, b"", 0), 2: (0, b"", 1), 3: (0, b"", 0)}


def test_every_labelled_language_is_in_the_model(spark):
    from sextant.llm import langid

    rows = [(i * 100 + k, f"word{i} and thing{i} of kind{i}", f"l{i:03d}") for i in range(90) for k in range(1 + i % 3)]
    rows += [(90_000 + k, "the one common text", "l000") for k in range(3000)]
    languages, logs = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=900)
    assert languages == [f"l{i:03d}" for i in range(90)] and logs.shape == (90, langid.BUCKETS)
    assert all(logs[i].max() > logs[i].min() for i in range(90))
