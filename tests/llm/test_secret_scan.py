import hashlib
import random
import re

import pytest

from sievelake.llm import secret_scan as secrets
from sievelake.llm.common import kept
from tests.llm.util import docs

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    text = text or ""
    kinds = [
        [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8],
        [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16],
        [m.span() for m in HEX.finditer(text) if len(m[0]) >= 32],
    ]
    spans = sorted((a, k, b) for k, found in enumerate(kinds) for a, b in found)
    joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*map(len, kinds), hashlib.sha256(joined.encode()).hexdigest())


RANDOM = "Zq7Xv0pL9sT3kW8yB2nM5cR1"


def fixture():
    rng = random.Random(3)
    parts = ["password=", "Token : \"", "API_KEY='", "apikey=", "secret: token: ", "AKIA", "AKIA" + "B" * 14, "0af3" * 9, "a" * 32]
    parts += ["abc.def=/+12-_", "short", " ", "\n", "É日😀", "$1\\", "\ue000", "\ue001 bx", "k" * 9, "'", "=", ":", "KEY"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(150)]
    texts += [None, "", "ſecret=12345678", "toKen=12345678", "plain words are here " * 40, "pad " * 20000 + "password=abcdefgh1"]
    words = "customer invoice thunder marmalade station_name holiday forest".split()
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    texts += [" ".join(f"{rng.getrandbits(160):040x}" for _ in range(9)) for _ in range(40)]
    texts += [" ".join("AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) for _ in range(20)) for _ in range(40)]
    return texts


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.log_ratios(kept(secrets.labelled_sample(docs(spark, fixture())), "tokens"))


def test_base_against_brute_force(spark, ratios):
    wide = docs(spark, fixture()).selectExpr("*", "1 as spans", "2 as _text", "3 as found")
    got = {r.doc_id: r for r in secrets.scan(wide, ratios).collect()}
    for i, text in enumerate(fixture()):
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(text), text
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_random_strings(spark, ratios):
    texts = [f"see {RANDOM} here", "see customer_invoice_station_holiday2 here", "see https/forest/holiday/station_name1 x"]
    got = {r.doc_id: r.spans for r in secrets.scan(docs(spark, texts), ratios).collect()}
    assert got == {0: "random:4:28", 1: "", 2: ""}


def test_redaction(spark):
    texts = ["É password=abcdefgh1 and " + "0af3" * 9 + "!", "nothing here", None, "token=" + "0af3" * 9]
    wide = docs(spark, texts + fixture()).selectExpr("*", "1 as found", "2 as _row")
    got = {r.doc_id: r for r in secrets.clean(wide).collect()}
    assert [got[i].text for i in range(4)] == ["É [SECRET] and [SECRET]!", "nothing here", None, "[SECRET]"]
    assert got[0].n_chars == len(got[0].text) and got[0].found == 1 and got[0]._row == 2
    assert len(got) == len(texts) + len(fixture())


def test_empty_table(spark):
    none = docs(spark, [])
    ratios = secrets.log_ratios(kept(secrets.labelled_sample(none), "tokens"))
    assert set(ratios) == {0.0} and secrets.scan(none, ratios).collect() == []
    assert secrets.clean(none).collect() == []
