"""PII, secrets, language, media: against brute force, and on odd inputs."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexframe.llm import automaton, language, media, pii, secrets, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


ODD = [(1, None, "x"), (2, "", "x"), (3, "a" * 300_000, "x"), (4, "mail a@b.co now", "x"), (4, "mail a@b.co now", "x"), (None, "password=hunter22", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with the results'."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"SPANS": F.lit("old"), "n_email": F.lit("old"), "n_hex": F.lit("old"), "lang_pred": F.lit(1), "score": F.lit("s"), "feature": F.lit(0)})


def brute_pii(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_pii_matches_the_grammar(texts):
    rnd = random.Random(1)
    made = ["".join(rnd.choice("0123456789..@@+- ()aA-b_%4é") for _ in range(rnd.randrange(60))) for _ in range(20_000)]
    for t in [*texts, *made, "1.2.3.4.5.6.7.8", "a@b.c@d.e", "4111 1111 1111 1111", "+1 (2) 3456789"]:
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == brute_pii(t)


def test_pii_beside_the_grammar():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t)]
    assert ("account", "DE89370400440532013000") in kinds("IBAN: DE89370400440532013000.")
    assert ("account", "AB-123456") in kinds("Account no. AB-123456, thanks")
    assert ("address", "12 Baker Street") in kinds("at 12 Baker Street now")
    assert ("url", "ftp://me:pw@host.example") in kinds("see ftp://me:pw@host.example/x")
    assert ("account", "DE89 3704 0044 0532 0130 00") in kinds("pay DE89 3704 0044 0532 0130 00 now") and ("account", "GB29NWBK60161331926819") in kinds("(GB29NWBK60161331926819)")
    assert not [x for x in kinds("pay DE88 3704 0044 0532 0130 00 now, or XDE89370400440532013000") if x[0] == "account"]
    assert ("account", "12 345 678 901") in kinds("Kontonummer: 12 345 678 901") and ("account", "X" * 50 + "123456") in kinds("Passport " + "X" * 50 + "123456")
    for street in ("12 Baker St.", "7b Old Mill Rd.", "Hauptstraße 12", "Am Gartenweg 3 a", "Schillerplatz 5", "12 rue de la Paix", "5 avenue Victor Hugo", "Calle Mayor 12", "Avenida de América, 5", "9 " + "A" + "b" * 90 + " Lane"):
        assert ("address", street.removeprefix("Am ")) in kinds(f"at {street}, then"), street
    assert ("url", "x" * 40 + "://me:pw@host") in kinds("see " + "x" * 40 + "://me:pw@host")
    for clean in ("la rue 12 Mai", "weg 5", "the Avenue", "12 place of", "Plaza Mayor", "mein weg 12", "in 1999 Street life", "a Drive 5", "2 st. Peter", "an account of the year 1999", "the street was long", "https://host.example/a:b", "accounting 123456"):
        assert pii.find(clean) == []
    assert pii.redact("x a@b.co +1 2345678", pii.find("x a@b.co +1 2345678")) == "x [EMAIL] [PHONE]"


def test_pii_odd_rows(odd):
    rows = pii.scan(odd).collect()
    assert len(rows) == len(ODD) and "source" in rows[0].asDict() and "SPANS" not in rows[0].asDict()
    by = {(r.doc_id, r.text and r.text[:4]): r for r in rows}
    assert by[(1, None)].n_email == 0 and by[(1, None)].text_redacted is None and by[(1, None)].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[(4, "mail")].n_email == 1 and by[(4, "mail")].spans == "email:5:11"
    assert pii.scan(odd.limit(0)).count() == 0


def brute_secrets(t):
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    t = t or ""
    out = [("assign", *m.span()) for m in re.finditer(f"({name})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_match_the_grammar(texts):
    rnd = random.Random(2)
    parts = ["password", "Secret", "token", "api_key", "ApiKEY", "AKIA", "=", ":", " ", '"', "'", "abc123", "0123456789abcdef", "\n", "é", "ABCDEFGH12", "deadbeef", "ghp_" + "a" * 36]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(5_000)]
    every = [*texts, *made, None, ""]
    for t, spans in zip(every, secrets.find_all(pa.array(every), secrets.scanner()), strict=True):
        assert [s for s in spans if s[0] in secrets.BASE] == brute_secrets(t)


def test_extra_secrets_match_whole_texts(texts):
    rnd = random.Random(12)
    parts = ["://", "admin", ":", "p4ss!w0rd", "a$b*c", "%40", "+", "@", "@host", "\n", " ", ",", "é", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "a1B2" * 9, "xoxb-", "1234-abcdef", "eyJ", "abcdefghij_", ".eyJ", "."]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(16))) for _ in range(20_000)]
    made += ["db://admin:p4ss!w0rd@host", "x://u%2Fv:a$b*c%40!@h", "é://a:!!@b ://c:$@d", "eyJabcdefghij_.eyJabcdefg.x-y"]
    extra = [k for k in secrets.KINDS if k not in secrets.BASE]
    hit = set()
    for t, spans in zip([*texts, *made], secrets.find_all(pa.array([*texts, *made]), secrets.scanner()), strict=True):
        want = {(k, *m.span()) for k in extra for m in re.finditer(secrets.RULES[k][0], t or "")}
        got = [s for s in spans if s[0] in extra]
        assert set(got) == want and len(got) == len(want)
        hit |= {k for k, _, _ in want}
    assert hit == set(extra)


def test_secrets_of_one_long_line(texts):
    rnd = random.Random(15)
    line = " ".join(rnd.choice(["word", "password: hunter22x", "deadbeef" * 4, "AKIA" + "Q" * 20, "é"]) for _ in range(60_000))
    start = time.process_time()
    got, = secrets.find_all(pa.array([line]), secrets.scanner())
    assert time.process_time() - start < 15
    assert [s for s in got if s[0] in secrets.BASE] == brute_secrets(line)


def test_secrets_odd_rows(odd):
    rows = secrets.scan(odd).collect()
    assert len(rows) == len(ODD)
    assert [r.spans for r in rows if r.doc_id is None] == ["assign:0:17"]
    assert [r.n_hex for r in rows if r.doc_id == 3] == [1]
    assert secrets.scan(odd.limit(0)).count() == 0


def test_automaton_against_re():
    rules = {"a": "ab{2,3}c?", "b": "(x|yz)+[^a-w]", "c": r"\x41.B", "d": "k{3,}", "e": "(pq){2}"}
    dfa = automaton.compile_rules(rules)
    rnd = random.Random(3)
    lines = ["".join(rnd.choice("abcxyzAB kpq1") for _ in range(rnd.randrange(20))) for _ in range(3000)]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in lines])
    bits = dfa.scan(data, ends - [len(x) for x in lines], ends)
    for line, got in zip(lines, bits, strict=True):
        assert got == sum(bool(re.search(p, line)) << k for k, p in enumerate(rules.values()))
    for rule in ("ab{2,3}c?", "(x|yz)+[^a-w]", "k{3,}", "(pq){2}"):
        back, ahead = automaton.compile_rules({"r": rule}, backward=True), automaton.compile_rules({"r": rule}, anchored=True)
        for line in lines:
            raw, starts = line.encode(), back.marks(line.encode())
            assert starts == [k for k in range(len(line)) if re.compile(rule).match(line, k)]
            assert [ahead.longest(raw, k) for k in starts] == [re.compile(rule).match(line, k).end() for k in starts]
    for bad in ("(a", "a)", "[a"):
        with pytest.raises((ValueError, IndexError)):
            automaton.compile_rules({"x": bad})


def plain_ppm(train, text, order):
    """Bits of a text under a recursive escape computation."""
    padded = b" " * order + train.encode()
    seen = {}
    for k in range(order, len(padded)):
        for n in range(order + 1):
            counts = seen.setdefault(padded[k - n : k], {})
            counts[padded[k]] = counts.get(padded[k], 0) + 1

    def prob(context, x):
        shorter = prob(context[1:], x) if context else 1 / 256
        counts = seen.get(context, {})
        total = sum(counts.values()) + len(counts)
        return shorter if not counts else counts[x] / total if x in counts else len(counts) / total * shorter

    padded = b" " * order + text.encode()
    return -sum(np.log2(prob(padded[k - order : k], padded[k])) for k in range(order, len(padded)))


def test_language_code_lengths_against_plain_ppm(spark):
    trained = {"en": "the thin thing then", "de": "das ding dünn", "zh": "你好吗你们好"}
    model = language.train(spark.createDataFrame([(v, k) for k, v in trained.items()], "text string, lang string"))
    rnd = random.Random(4)
    texts = ["", "the", None, "ü", *("".join(rnd.choice([*"thinge du", "ü", "你", "好", "x"]) for _ in range(rnd.randrange(40))) for _ in range(200))]
    bits = language.code_lengths(model, pa.array(texts))
    for row, text in zip(bits, texts, strict=True):
        assert row.tolist() == pytest.approx([plain_ppm(trained[x], text or "", 3) for x in model.languages], rel=1e-9)


def test_language_numbers_codes():
    rng = np.random.default_rng(3)
    for codes in (rng.integers(0, 2**32, 300_000).astype(np.uint32), rng.integers(0, 50, 1000).astype(np.uint32), np.zeros(0, np.uint32)):
        names, number = language.distinct(codes)
        assert len(np.unique(names)) == len(names) and (names[number] == codes).all() and len(names) == len(np.unique(codes))


def test_language_forty_languages_keep_their_order(spark):
    """Artificial languages: each builds its words from syllables of its own."""
    rnd = random.Random(8)
    syllables = {f"l{k:02d}": ["".join(rnd.choice("aeioubcdfgklmnprst") for _ in range(3)) for _ in range(40)] for k in range(40)}
    text = lambda lang, n: " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    model = language.train(spark.createDataFrame([(text(x, 300), x) for x in syllables for _ in range(3)], "text string, lang string"))
    assert model.order == 3 and len(model.languages) == 40 and max(int(c.max()) for c, _ in model.counts.values()) > 2**24
    got = language.identify(spark.createDataFrame([(x, text(x, 30)) for x in syllables for _ in range(5)], "lang string, text string"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", language.held_out())
    model = language.train(docs.where("NOT held"))
    got = language.identify(docs.where("held").select("lang", "text"), model).collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd):
    train = spark.createDataFrame([("the cat and the hat", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None), ("", "en")], "text string, lang string")
    rows = {(r.doc_id, r.text and r.text[:4]): (r.lang_pred, r.score) for r in language.identify(odd, language.train(train)).collect()}
    assert rows[(1, None)] == ("und", 0.0) and rows[(2, "")] == ("und", 0.0) and rows[(4, "mail")][0] in ("en", "de")
    empty = language.train(train.limit(0))
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(odd.limit(0), empty).count() == 0
    tie = language.train(spark.createDataFrame([("ab", "b"), ("ab", "a")], "text string, lang string"))
    assert {r.lang_pred for r in language.identify(odd.where("doc_id = 4"), tie).collect()} == {"a"}


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_formats():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    wav = media.wav(b"abcd")
    samples = {
        "image/png": png(), "audio/wav": wav, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"hello"),
        "image/gif": b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;",
        "image/bmp": struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4,
        "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xy\xff\0z\xff\xd9", "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF",
        "application/ogg": b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc", "video/mp4": struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"free"),
    }
    for kind, data in samples.items():
        assert (kind, 0, len(data)) in media.carve(data), kind
        assert (kind, 5, 5 + len(data)) in media.carve(b"12345" + data), kind
        assert not [x for x in media.carve(data[: len(data) - 1]) if x[0] == kind and x[1] == 0], kind
    assert media.carve(None) == media.carve(b"") == media.carve(b"BM and GIF8 and \xff\xd8\xff in a text") == []
    assert media.read_back(media.wav(b"\x01" * 576)) == b"\x01" * 576


def test_media_sniff(spark):
    df = spark.createDataFrame([(1, bytearray(png() + b"xx" + media.wav(b"abcd")), "image/jpeg"), (2, None, "image/png"), (3, bytearray(b""), None)], "id long, data binary, declared string").withColumn("Embedded", F.lit(1))
    rows = {r.id: r for r in media.sniff(df, "data", "declared").collect()}
    assert (rows[1].media_type, rows[1].declared_ok, rows[1].embedded[0].type) == ("image/png", False, "audio/wav")
    assert (rows[2].media_type, rows[2].declared_ok, rows[3].media_type) == (None, None, "application/octet-stream")
    assert media.sniff(df.limit(0), "data").count() == 0


def test_media_describe(odd):
    for r in media.describe(odd).collect():
        raw = (r.text or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(pad) + 44, hashlib.sha256(media.wav(pad)).hexdigest())
        steps = [abs(a - b) for a, b in zip(pad, pad[1:])]
        mean = sum(pad) / len(pad)
        sd = (sum((b - mean) ** 2 for b in pad) / len(pad)) ** 0.5
        assert r.feature == f"audio/wav;samples={len(pad)};mean={mean:.4f};sd={sd:.4f};step={sum(steps) / len(steps):.4f};embedded=0"
    assert media.describe(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hostile", [b"%PDF-1", b"PK\x03\x04", b"%PDF-1startxref", b"OggS\0\0" + b"\0" * 20 + b"\x01\x01x"])
def test_media_hostile_bytes_take_linear_time(hostile):
    start = time.process_time()
    assert media.carve(hostile * (3_000_000 // len(hostile))) == []
    assert time.process_time() - start < 20


def test_tokens_match_the_tokenizer(spark, texts):
    words = tokens.words()
    every = [*texts, *(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()), "It's we'll THE'RE don't!'s ???", "a<|endoftext|>b", "Ünïcode ŠŽ ǅ ΑΣ", "\x1c\x85 a\xa0b", "日本語 🎉", "e\u0301", "", " ", "''s' x² ½"]
    every = [t or "" for t in every]
    for text, want in zip(every, words.whole.encode_batch(every, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == want.ids
