import hashlib
import random
import time

import duckdb
import pytest
from llm_rows import awkward, empty

from tokenlake.llm import secrets as S
from tokenlake.llm.common import read_table

SF = "/root/testdata/sf0.01"
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")


def brute_base(text):
    """The three patterns character by character."""

    def run(i, allowed):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        return j

    def assign(i):
        for key in KEYS:
            if text[i : i + len(key)].translate({c: c + 32 for c in range(65, 91)}) == key:
                j = i + len(key)
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                j = run(j, " ")
                if text[j : j + 1] not in (":", "="):
                    return None
                j = run(j + 1, " ")
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                return (run(j, VALUE), run(j, VALUE) - j >= 8) if run(j, VALUE) > j else None
        return None

    def access(i):
        if not text.startswith("AKIA", i):
            return None
        j = run(i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        return (j, j - i >= 16) if j > i + 4 else None

    def digits(i):
        j = run(i, set("0123456789abcdef"))
        return (j, j - i >= 32) if j > i else None

    spans = []
    for k, find in enumerate((assign, access, digits)):
        i = 0
        while i < len(text):
            hit = find(i)
            if hit and hit[1]:
                spans.append((i, k, hit[0]))
            i = hit[0] if hit else i + 1
    return [(a, b, S.KINDS[k]) for a, k, b in sorted(spans)]


def literals(text):
    return [text[a:b] for a, b, _ in S.lexed_spans(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('db_pwd = "hunter2xyz9"', ["hunter2xyz9"]),
        ("config['auth-password'] = 'k3y-of-the-castle'", ["k3y-of-the-castle"]),
        ('{"clientSecretKey": "Zx81_qwerty", "user": "somebody12"}', ["Zx81_qwerty"]),
        ("PASSPHRASE: str = 'tr0ub4dor&3'", ["tr0ub4dor&3"]),
        ('k = "s3cr3tv4lue!"\nconn.passwd_ = k', ["s3cr3tv4lue!"]),
        ("a = 'n0t-plain-1'\nb = a\nself.access_key = b", ["n0t-plain-1"]),
        ("login(creds_password)\ncreds_password = base\nbase = 'first9after'", ["first9after"]),
        ('pwd = "abcd" + "efgh12"', ["abcd", "efgh12"]),
        ("pwd = ('abcd'\n       'efgh12')", ["abcd", "efgh12"]),
        ('pwd = os.getenv("DB_PWD_NAME_1", "f4llback-pw")', ["f4llback-pw"]),
        ('builder.setPassphrase("0pen.sesame")', ["0pen.sesame"]),
        ('props.put("db.passphrase", "0pen.sesame")', ["0pen.sesame"]),
        ("<passphrase>0pen.sesame</passphrase>", ["0pen.sesame"]),
        ('<property name="passphrase" value="0pen.sesame"/>', ["0pen.sesame"]),
        ("run --passphrase 0pen.sesame --user bob", ["0pen.sesame"]),
        ("run --passphrase=0pen.sesame --user bob", ["0pen.sesame"]),
        ("export PRIVATE_KEY=QUJDREVGR0hJSktM9a=", ["QUJDREVGR0hJSktM9a="]),
        ("signing key: 1a2b3c4d5e6f7g8h9i0j", ["1a2b3c4d5e6f7g8h9i0j"]),
        # nothing secret
        ("The passphrase: remember it well", []),
        ('password_file = "/etc/app/pw1.txt"', []),
        ('pwd = "changeme123"', []),
        ('pwd = "${DB_PASSWORD1}"', []),
        ('pwd = "two words 12"', []),
        ('colour = "a1b2c3d4e5f6"', []),
        ("user = 'k3y-of-the-castle'\nname = user", []),
        ("don't use pwd, it's bad: never", []),
        ("pwd == 'k3y-of-the-castle'", []),
        ("pwd = 'short1'", []),
        ("http://pwd:8080/abcdef12345", []),
    ],
)
def test_pairs(text, found):
    assert literals(text) == found


def make(rng):
    """A program and the secret literals in it, known by construction."""
    lines, secret, tail = [], [], "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    value = lambda: "".join(rng.choice(tail) for _ in range(rng.randint(9, 14))) + rng.choice("0123456789") + rng.choice("abc")
    for n in range(rng.randint(1, 30)):
        bad, v = rng.random() < 0.4, value()
        name = rng.choice(["db_pwd", "clientPassphrase", "app.credentials", "MASTER_KEY"]) if bad else rng.choice(["colour", "userName", "app.region", "pwd_file"])
        form = rng.randrange(7)
        if form == 0:
            lines.append(f'{name} = "{v}"')
        elif form == 1:
            lines.append(f"  '{name}': '{v}',")
        elif form == 2:
            lines.append(f"{name}={v}")
        elif form == 3:
            lines.append(f'const v{n} = "{v}";\n{name} := v{n}')
        elif form == 4:
            lines.append(f'v{n} = "{v}"\nw{n} = v{n}\nprint(w{n})\n{name} = w{n}')
        elif form == 5:
            lines.append(f'map["{name}"] = f"{v}"  # {value()}')
        else:
            lines.append(f"{rng.choice(['it is so', 'one, two', 'x > y'])}\ncall(\"{name}\", '{v}')")
        if bad:
            secret.append(v)
    return "\n".join(lines), secret


def test_programs_with_known_secrets():
    for seed in range(300):
        text, secret = make(random.Random(seed))
        assert sorted(literals(text)) == sorted(secret), text


def test_patterns_equal_brute_force():
    rng = random.Random(1)
    bits = ["token", "ſecret", "Api_Key", "APIKEY", "passWD", "password", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA0123456789", "é", "\n",
            "abcdef0123456789", "0123456789abcdef", "x", "Z9", "secret: short", "Key", "+/"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert S.base_spans(text) == brute_base(text), text


def test_spans_of_lexer_and_patterns_are_joined():
    text = 'pwd = "hunter2xyz9"; token = "abcdefgh12"'
    base, spans = S.scan_text(text)
    assert S.shown(base) == "assign:21:40" and S.shown(spans) == "lexed:7:18,assign:21:40"


def test_long_texts_take_linear_time():
    t0 = time.time()
    for piece in ("pwd = pwd = ", "a=", "'\\'", '"', "f(", "token:", "<a>", "--a ", "x = (", "key = key\n", "é: ", "AKIA", "abc"):
        S.scan_text(piece * 60_000)
    assert time.time() - t0 < 60


def test_query_equals_brute_force_on_documents(spark):
    docs = read_table(spark, SF, "documents")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = S.find_secrets(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = brute_base(text[r.doc_id]) if r.doc_id % 5 == 0 or r.n_assign + r.n_access + r.n_hex else []
        counts = [sum(k == kind for _, _, k in base) for kind in ("assign", "access", "hex")]
        assert counts == [r.n_assign, r.n_access, r.n_hex]
        assert r.base_sha256 == hashlib.sha256(S.shown(base).encode()).hexdigest()
        kept = [x for x in r.spans.split(",") if x and not x.startswith("lexed:")]
        assert ",".join(kept) == S.shown(base)


def test_patterns_equal_sql_on_documents(spark):
    """Counts of all documents against DuckDB's own regular expressions."""
    con = duckdb.connect()
    key = S._either_case("(?:password|passwd|secret|token|api_?key)")
    sql = f"""SELECT doc_id,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '{key}["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS a,
      len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS k,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS h
      FROM read_parquet('{SF}/documents.parquet')"""
    want = sorted(con.execute(sql).fetchall())
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in S.find_secrets(read_table(spark, SF, "documents")).collect())
    assert got == want and sum(a for _, a, _, _ in want) > 0


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = S.find_secrets(docs).collect()
    assert len(rows) == docs.count() and all(r.spans == "" for r in rows)
    assert S.find_secrets(empty(docs)).count() == 0
