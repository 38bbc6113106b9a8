import hashlib
import random
import zlib

from palaver.llm import secret_scan as s


def base(text):
    spans = [(m.start(), m.end(), "assign") for m in s.ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), m.end(), "access") for m in s.ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), m.end(), "hex") for m in s.HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda x: (x[0], s.KINDS.index(x[2])))


def github(body):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, k = divmod(value, 62)
        digits = s.BASE62[k] + digits
    return f"ghp_{body}{digits.rjust(6, '0')}"


def test_base_spans_against_plain_search():
    r = random.Random(3)
    parts = ["password", "PassWD", "secret", "token", "API_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "f" * 31, "f" * 33, "x", "Ä", "İ", "ſecret", "K", "\n", ".", "abcd1234", "-"]
    found = 0
    for _ in range(5000):
        text = "".join(r.choices(parts, k=r.randint(1, 14)))
        got = [x for x in s.scan(text, s._automaton()) if x[2] in s.BASE]
        assert got == base(text), text
        found += len(got)
    assert found > 1500


def test_checksums():
    good = github("0" * 10 + "aZ" * 10)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    keys = s._automaton()
    assert [x[2] for x in s.scan(f"a {good} b", keys)] == ["github"] and s.scan(f"a {bad} b", keys) == []
    raw = bytes.fromhex("0488ADE4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    value, out = int.from_bytes(raw, "big"), ""
    while value:
        value, k = divmod(value, 58)
        out = s.BASE58[k] + out
    assert out.startswith("xprv") and [x[2] for x in s.scan(f"key {out}", keys)] == ["xprv"]
    assert s.scan("key " + out[:-1] + ("2" if out[-1] != "2" else "3"), keys) == []


def test_query_shape(spark):
    long = "é" * 100_000 + ' password = "hunter2hunter2"'
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, long, 5), (3, long, 5), (None, "token: 12345678", 5)], "doc_id long, text string, n_hex int")
    got = sorted(((r["doc_id"] or 0), r["n_assign"], r["base_sha256"], r["spans"]) for r in s.scan_documents(df).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1:3] == [(1, 0, empty, ""), (2, 0, empty, "")] and got[0][3] == "assign:0:15"
    assert got[3] == got[4] and got[3][3].startswith("assign:100001:") and got[3][2] == hashlib.sha256(got[3][3].encode()).hexdigest()
    assert s.scan_documents(df.where("false")).count() == 0
