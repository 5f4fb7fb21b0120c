"""Secret scans against the plain patterns."""

import hashlib
import random
import re

from splicework.llm import secrets

PATTERNS = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
)


def base_model(text):
    spans = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))
    return [f"{PATTERNS[i][0]}:{s}:{e}" for s, i, e in spans]


def test_against_patterns(spark):
    draw = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "apikey", "=", ": ", '"', "'", " ", "abc123", "x" * 7, "AKIA", "AKIA" + "Z" * 18, "AKIAAKIA", "é", "İ", "ß", "0123456789abcdef" * 2, "deadbeef", "\n", "😀", "tokentoken=", "secretoken"]
    texts = [None, "", "x" * 300000 + "token=abcdef99"] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(1500)]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digests(secrets.scan(df)).collect())
    want = []
    for t in texts:
        spans = base_model(t)
        want.append((*[sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert got == sorted(want)
    assert secrets.scan(df.limit(0)).count() == 0


def test_checksums(spark):
    body = "A1b2C3d4E5" * 3
    good, bad = f"ghp_{body}{secrets.crc_base62(body)}", f"npm_{body}AAAAAA"
    df = spark.createDataFrame([(1, f"é {good} {bad} npm_{body}{secrets.crc_base62(body)}")], "doc_id long, text string")
    assert secrets.digests(secrets.scan(df)).first().spans == "github:2:42,npm:84:124"
