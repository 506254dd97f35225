import datetime
import decimal
import hashlib
import hmac
import os
import struct
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushlake.errors import SealError, from_spark
from hushlake.functions import codec
from hushlake.functions.crypto import SHARDS, FieldCipher, envelope_shape, hmac_col, salt_col, shard_col, stamp_col
from hushlake.functions.framing import canonical, frame, framed_col
from hushlake.functions.keys import Keyring, hkdf
from hushlake.functions.normalize import DIGITS, KEEP_SPACES, WHITE, compact, nfc, normalize, normalize_col, normalize_sql
from hushlake.operators.companion import proof_key_col, token_col
from hushlake.plans import model as s
from hushlake.plans.tokens import ProfileKeys, pieces, stamp


def code(e):
    return e.value.code


def fnv(raw):
    h = 0x811C9DC5
    for b in raw:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


TEXTS = ["", "a", "AB c", "É É é", "Ｆｕｌｌ　ｗｉｄｔｈ", "İSTANBUL ß", "a b c　d﻿e​f", "😀 x 가나다", "한글 테스트", "Z\tZ\nZ"]


def test_hashes_equal_the_standard_library(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    key = os.urandom(32)
    got = rows.select("t", hmac_col(key, F.col("t").cast("binary"), 256).alias("a"), hmac_col(key, F.col("t").cast("binary"), 384).alias("b"), shard_col(F.col("t")).alias("c"), framed_col(["x", b"yz"], [F.col("t").cast("binary"), F.lit("q").cast("binary")]).alias("d"), stamp_col(F.lit(bytearray(key)), F.lit("salt").cast("binary"), F.lit(7)).alias("e")).collect()
    for r in got:
        raw = r.t.encode()
        assert bytes(r.a) == hmac.digest(key, raw, "sha256") and bytes(r.b) == hmac.digest(key, raw, "sha384")
        assert r.c == fnv(raw) % SHARDS
        assert bytes(r.d) == frame(["x", b"yz", raw, "q"])
        assert r.e == stamp(key, b"salt", 7) == struct.unpack(">q", hashlib.sha256(key + b"salt" + b"\0\0\0\7").digest()[:8])[0]


def test_normalization_is_one_rule_in_three_places(spark):
    import duckdb

    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    con = duckdb.connect()
    for kind in ("default", KEEP_SPACES):
        got = [r[0] for r in rows.select(normalize_col(nfc(F.col("t")), kind)).collect()]
        sql = [con.execute(f"SELECT {normalize_sql('?', kind)}", [t]).fetchall()[0][0] for t in TEXTS]
        assert got == [normalize(t, kind) for t in TEXTS] == sql
    assert len(set(WHITE)) == 25
    assert normalize("ÉÀ") == "ÉÀ" and normalize("A É") == "aÉ"
    assert compact("A  b", KEEP_SPACES) == "ab" and normalize("A  b", KEEP_SPACES) == "a  b"


def test_digits(spark):
    assert normalize("+49 (30) 12-34.5", DIGITS) == "4930" + "12345"[0:5] and normalize("", DIGITS) == ""
    for bad in ("12a", "+", "--", "1+2"):
        with pytest.raises(SealError) as e:
            normalize(bad, DIGITS)
        assert code(e) == "INVALID_VALUE"
        with pytest.raises(Exception, match="INVALID_VALUE"):
            spark.createDataFrame([(bad,)], "t string").select(normalize_col(F.col("t"), DIGITS)).collect()
    ok = ["+1 (2) 3", "", None, "１２"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ok], "t string").select(normalize_col(F.col("t"), DIGITS)).collect()]
    assert got == ["123", "", None, "12"]


@given(st.text(max_size=30))
def test_normalize_is_stable(text):
    once = normalize(text)
    assert normalize(once) == once and not set(once) & set(WHITE)
    assert unicodedata.is_normalized("NFC", unicodedata.normalize("NFC", once))


def test_keys_differ_by_everything():
    a, b = Keyring(bytes(32)), Keyring(bytes(31) + b"\1")
    seen = {a.derive("m", "token", ["f"], 32), a.derive("m", "proof", ["f"], 32), a.derive("n", "token", ["f"], 32), a.derive("m", "token", ["g"], 32), b.derive("m", "token", ["f"], 32)}
    assert len(seen) == 5 and len(hkdf(b"k", b"i", 100)) == 100
    fixed = Keyring(models={"m": bytes(32)})
    assert fixed.scope("m") == "model:m" and a.scope("m") == "global"
    with pytest.raises(SealError) as e:
        fixed.derive("other", "token", [], 32)
    assert code(e) == "KEY_NOT_FOUND"
    with pytest.raises(SealError):
        Keyring(b"short")
    import pickle

    with pytest.raises(TypeError):
        pickle.dumps(a)


def test_canonical_tells_values_apart():
    values = [None, True, False, 1, 1.0, "1", b"1", [1], [[1]], ["1"], {"a": 1}, {"a": "1"}, {"1": 1}, [], {}, "", decimal.Decimal(1), datetime.date(2020, 1, 1)]
    assert len({canonical(v) for v in values}) == len(values)
    assert canonical({"a": 1, "b": 2}) == canonical({"b": 2, "a": 1})


VALUES = {
    "text": ["", "x", "é\0"], "integer": [0, -5, 2**53 - 1], "bigint": [0, -(10**30)], "boolean": [True, False],
    "instant": [datetime.datetime(2024, 1, 2, 3, 4, 5, 678000), datetime.datetime(1969, 12, 31, 23, 59, 59, 999000)], "json": ['{"b":1,"a":[null]}', "null"], "bytes": [b"", b"\0\xff"],
}


def test_codecs_round_trip(spark):
    for kind, values in VALUES.items():
        typed = spark.createDataFrame([(decimal.Decimal(v) if kind == "bigint" and v is not None else v,) for v in [*values, None]], f"v {codec.spark_type(kind)}")
        raw = typed.select("v", codec.encode_col(kind, F.col("v")).alias("raw"))
        for r in raw.select("v", "raw", codec.decode_col(kind, F.col("raw")).alias("back")).collect():
            assert r.v == r.back
            if r.v is not None and kind != "json":
                python = int(r.v) if kind == "bigint" else bytes(r.v) if kind == "bytes" else r.v
                assert bytes(r.raw) == codec.encode(kind, python)
                assert codec.decode(kind, bytes(r.raw)) in (python, getattr(python, "replace", lambda **_: None)(tzinfo=datetime.UTC) if kind == "instant" else python)
    rows = spark.createDataFrame([(decimal.Decimal("-1.50"),), (decimal.Decimal("0.00"),), (None,)], "v decimal(12,2)")
    assert [None if r[0] is None else bytes(r[0]) for r in rows.select(codec.encode_col("decimal", F.col("v"), 12, 2)).collect()] == [b"-1.50", b"0.00", None]
    assert codec.encode("decimal", "+001.5", 12, 2) == b"1.50" and codec.encode("decimal", "-0.00", 12, 2) == b"0.00"


def test_codecs_reject(spark):
    for kind, value in (("integer", 2**53), ("integer", 1.5), ("integer", True), ("text", 5), ("text", "\ud800"), ("bigint", "1"), ("decimal", "1.234"), ("decimal", "x"), ("boolean", 1), ("json", {1, 2}), ("json", float("nan")), ("bytes", "x")):
        with pytest.raises(SealError) as e:
            codec.encode(kind, value, 12, 2)
        assert code(e) == "INVALID_VALUE"
    for kind, raw in (("integer", b"007"), ("boolean", b"\2"), ("decimal", b"1.5"), ("text", b"\xff"), ("bigint", b"-0")):
        with pytest.raises(SealError) as e:
            codec.decode(kind, raw, 12, 2)
        assert code(e) == "INVALID_CIPHERTEXT"
    with pytest.raises(Exception, match="INVALID_VALUE"):
        spark.range(1).select(codec.encode_col("integer", F.lit(2**53))).collect()
    with pytest.raises(Exception, match="INVALID_VALUE"):
        spark.sql("select cast(1.239 as decimal(10,3)) as v").select(codec.encode_col("decimal", F.col("v"), 12, 2)).collect()


def test_sealed_values_are_bound(spark):
    ring = Keyring(bytes(range(32)))
    cipher = FieldCipher(ring, "m", "f", "text", "")
    rows = spark.createDataFrame([("1", "s", "héllo"), ("2", "s", ""), ("3", "t", "x" * 10_000)], "id string, scope string, v string")
    sealed = spark.createDataFrame(rows.withColumn("c", cipher.seal(F.col("v").cast("binary"), F.col("scope"), F.col("id"))).collect(), "id string, scope string, v string, c binary")
    back = lambda c, scope, row, frame=sealed: [r[0] for r in frame.select(c.open(F.col("c"), scope, row, strict=False).cast("string")).collect()]
    assert back(cipher, F.col("scope"), F.col("id")) == ["héllo", "", "x" * 10_000]
    for other, scope, row in ((cipher, F.lit("u"), F.col("id")), (cipher, F.col("scope"), F.lit("9")), (FieldCipher(ring, "m", "g", "text", ""), F.col("scope"), F.col("id")), (FieldCipher(ring, "n", "f", "text", ""), F.col("scope"), F.col("id")), (FieldCipher(ring, "m", "f", "json", ""), F.col("scope"), F.col("id")), (FieldCipher(Keyring(bytes(32)), "m", "f", "text", ""), F.col("scope"), F.col("id"))):
        assert back(other, scope, row) == [None] * 3
    assert [r[0] for r in sealed.select(envelope_shape(F.col("c"))).collect()] == [True] * 3
    with pytest.raises(Exception) as e:
        sealed.select(cipher.open(F.col("c"), F.lit("u"), F.col("id"))).collect()
    assert from_spark(e.value).code == "AUTHENTICATION_FAILED"
    with pytest.raises(Exception) as e:
        sealed.select(cipher.open(F.lit("short").cast("binary"), F.lit("u"), F.col("id"))).collect()
    assert from_spark(e.value).code == "INVALID_CIPHERTEXT"


def test_tokens_in_spark_and_python(spark):
    p = s.Profile("m", "f", s.EXACT, 12, "default", False, False, "text", "")
    keys = ProfileKeys.of(Keyring(bytes(32)), p)
    rows = spark.createDataFrame([(t, sc) for t in TEXTS for sc in ("_", "tenant")], "t string, s string")
    for r in rows.select("t", "s", token_col(keys, F.col("s"), F.col("t").cast("binary")).alias("a"), proof_key_col(keys, F.col("s"), F.col("t").cast("binary")).alias("b")).collect():
        assert r.a == keys.token_of(r.s, r.t.encode()) and bytes(r.b) == keys.proof_of(r.s, r.t.encode())
    assert keys.token_of("a", b"x") != keys.token_of("b", b"x")
    assert keys.token_of("a", b"x") & ((1 << 20) - 1) == 0
    assert len({keys.token_of("a", str(i).encode()) >> 20 & 0xFFF for i in range(3000)}) > 1500


def test_pieces():
    assert pieces("a", True) == [] and len(pieces("abc", True, True, True)) == 2 + 1 + 2
    assert len(pieces("aaaa", False)) == 1
    assert pieces("😀x", False) != pieces("x😀", False)


def test_salts_are_stored_as_used(spark, tmp_path):
    rows = spark.range(2000).withColumn("salt", salt_col())
    rows = rows.withColumn("st", stamp_col(F.lit("k").cast("binary"), F.col("salt")))
    rows.write.parquet(str(tmp_path / "x"))
    got = spark.read.parquet(str(tmp_path / "x")).collect()
    assert len({bytes(r.salt) for r in got}) == 2000
    assert all(len(r.salt) == 16 and r.st == stamp(b"k", bytes(r.salt)) for r in got)


def test_field_specs_are_checked():
    bad = [
        lambda: s.boolean(search={"exact": True}), lambda: s.integer(search={"substring": True}), lambda: s.text(search={}), lambda: s.text(search={"exact": {"bits": 1}}),
        lambda: s.text(search={"exact": {"bits": 33}}), lambda: s.text(search={"normalizer": "digits"}), lambda: s.text(search={"exact": True, "normalizer": "x"}), lambda: s.text(hardened=True),
        lambda: s.text(search={"exact": True, "odd": 1}), lambda: s.text(search={"exact": True, "protection": "none"}), lambda: s.text(id="a/b"), lambda: s.text(max_bytes=0), lambda: s.decimal(3, 4),
        lambda: s.text(search={"substring": {"skip_grams": 1}}), lambda: s.FieldSpec("float"), lambda: s.integer(search={"exact": True, "normalizer": "digits"}),
        lambda: s.Registration("m", "id", {"a": s.text(id="x"), "b": s.text(id="x")}), lambda: s.Registration("m", "id", {}), lambda: s.Registration("m", "id", {"a": s.text()}, plain=("a_ct",)),
    ]
    for make in bad:
        if make is bad[2]:
            make()  # an empty search is none
            continue
        with pytest.raises(SealError) as e:
            make()
        assert code(e) == "INVALID_SCHEMA"
    assert s.exact_bits_for_population(512) == 8 and s.exact_bits_for_population(100_000) == 15 and s.exact_bits_for_population(10**12) == 32
    with pytest.raises(SealError):
        s.exact_bits_for_population(511)
    hard, soft = (s.Registration("m", "id", {"a": s.text(search={"exact": True}, hardened=h)}).profile("a", "exact") for h in (True, None))
    assert hard.descriptor == soft.descriptor and "tokens_" in "".join(soft.columns) and "tokens_" not in "".join(hard.columns)
    for value, kind in (("", "text"), ("a\0", "text"), (5, "text"), ("A0000000-0000-0000-0000-000000000000", "uuid")):
        with pytest.raises(SealError) as e:
            s.identity(value, kind)
        assert code(e) == "INVALID_ID"
