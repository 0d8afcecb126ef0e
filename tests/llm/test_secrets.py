import hashlib
import random
import re
import tracemalloc

from opsweave.llm import queries, secrets
from tests.llm.conftest import SF


def brute_base(text):
    """The contract's patterns, read literally: every match, failing ones dropped."""
    text, found = text or "", []
    word = "|".join(["[pP][aA][sS][sS][wW][oO][rR][dD]", "[pP][aA][sS][sS][wW][dD]", "[sS][eE][cC][rR][eE][tT]", "[tT][oO][kK][eE][nN]", "[aA][pP][iI]_?[kK][eE][yY]"])
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


TEXTS = [
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "PASSWORD: hunter2x api_key=ab", "AKIA" + "A" * 15,
    "AKIA" + "A" * 16 + "akia", "secret='" + "0123456789abcdef" * 3 + "'", "é🙂 passwd := x", "tokentoken=abcdefgh",
    "ſecret=abcdefgh toKen=abcdefgh", "a" * 23 + " " + "b" * 24, 'apiKey" : "Zz9/+_.=-x"',
]


def test_base_spans_equal_the_patterns():
    for t in TEXTS:
        got = [f"{k}:{a}:{b}" for a, b, k in secrets.find_secrets(t) if k in secrets.KINDS[:3]]
        assert got == brute_base(t), t


def test_names_and_constants():
    kinds = lambda t: [(t[a:b], k) for a, b, k in secrets.find_secrets(t)]
    assert kinds('const k = "aB3dE5gH7jK9mN2p"\nclient_pwd: k\n') == [("aB3dE5gH7jK9mN2p", "flow")]
    assert kinds('a = "aB3dE5gH7jK9"\nb = a\nlogin_pwd = b + "xY8wQ2zR5t"') == [("aB3dE5gH7jK9", "flow"), ("xY8wQ2zR5t", "pair")]
    assert kinds('DB_PASS := "Zx81kQpL0m!"') == [("Zx81kQpL0m!", "pair")]
    assert kinds("pwd = 'your_password_here9' colour = 'aB3dE5gH7jK9mN2p'") == []
    assert kinds("meeting: 12:30, see http://x.org/a=b") == []


def test_query_against_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_secret_scan"](spark, SF).collect()}
    for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        base = brute_base(t)
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(b.startswith(k) for b in base) for k in secrets.KINDS[:3]]
        assert set(base) <= set(got[d]["spans"].split(","))
    assert len(got) == docs.count()


def test_edges(frame, edge_rows):
    rows = secrets.digest(secrets.scan(frame(edge_rows))).collect()
    assert len(rows) == len(edge_rows) and {r["spans"] for r in rows} == {""}
    assert secrets.scan(frame([])).count() == 0


def test_redaction(frame):
    df = secrets.redact_all(frame([(1, 'x token = "abcdef1234" y', "a"), (2, None, "a"), (3, "clean", "b")]))
    got = {r["doc_id"]: r for r in df.collect()}
    assert got[1]["text"] == 'x token = "[SECRET]" y' and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["n_chars"] is None
    assert df.columns == frame([]).columns


def flat(text):
    """pair and flow spans by copying every constant's spans at each use."""
    constants, more, covered = {}, {}, [(a, b) for a, b, _ in secrets.base_spans(text)]
    for m in re.finditer(r"^(\w+) = (.*)$", text, re.M):
        at, spans = m.start(2), []
        for piece in m[2].split(" + "):
            if piece in constants:
                spans += [(a, b, True) for a, b, _ in constants[piece]]
            else:
                spans.append((at + 1, at + len(piece) - 1, False) if piece[0] == '"' else (at, at + len(piece), False))
            at += len(piece) + 3
        constants[m[1]], weight = spans, secrets.name_weight(m[1])
        for a, b, through in spans if weight >= 0.5 else ():
            if weight + secrets.literal_weight(text[a:b]) >= 1.5 and not any(x <= a and b <= y for x, y in covered):
                more.setdefault((a, b), "flow" if through else "pair")
    return {(a, b, k) for (a, b), k in more.items()}


def test_constants_against_copied_spans():
    rng, found = random.Random(2), 0
    names = ["a", "b", "c", "key", "auth", "db_pwd", "my_secret_key", "signing"]
    literals = ['"aB3dE5gH7jK9mN2p"', '"abcdefgh"', '"Zx81kQpL0m"', '"0a1b2c3d4e"', '"short"', '"abababab1"']
    for _ in range(400):
        lines = [f"{rng.choice(names)} = " + " + ".join(rng.choice(names + literals) for _ in range(rng.randint(1, 3))) for _ in range(12)]
        text = "\n".join(lines)
        got = {x for x in secrets.find_secrets(text) if x[2] in ("pair", "flow")}
        assert got == flat(text), text
        found += sum(x[2] == "flow" for x in got)
    assert found > 100


def test_growing_constants():
    """Doubled constants, and a constant that grows line by line, take no more room than their text."""
    doubled = 's = "aB3dE5gH7jK9mN2p"\n' + "s = s + s\n" * 20 + "db_pwd = s\n"
    grown = 'db_pwd = "aB3dE5gH7jK9mN2p"\n' + 'db_pwd = db_pwd + "xY8wQ2zR5t"\n' * 2000
    for text, kinds in ((doubled, {"flow": 1}), (grown, {"pair": 2001})):
        tracemalloc.start()
        found = secrets.find_secrets(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {k: sum(x[2] == k for x in found) for k in {x[2] for x in found}} == kinds and peak < 5_000_000
