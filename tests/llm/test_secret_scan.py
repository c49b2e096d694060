import hashlib
import random
import re
import string

from tallyloom.llm import secret_scan as S

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def plain(text):
    """The patterns as they are worded, matches that are too short dropped after the search."""
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, g, n)) in enumerate(PLAIN.items()) for m in p.finditer(text) if len(m[g]) >= n]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def odd_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "toKen", "paſsword", '"', "'", "=", ":", " ", "  ", "\t", "\n", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6", "deadbeef" * 4, "0123abcd" * 5, "deadBeef", "é𝄞", ".", "-/+_=", "short", "longervalue1", "token: token: abcdefgh12"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_patterns_find_what_their_plain_wording_finds():
    texts = odd_texts(1, 4000)
    assert all(S.base_spans(t) == plain(t) for t in texts)
    assert {k for t in texts for _, _, k in plain(t)} == set(PLAIN)


def test_free_tokens_touch_no_span():
    for t in odd_texts(2, 800):
        spans = S.base_spans(t)
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t) if len(m[0]) >= 8 and not any(a < m.end() and b > m.start() for a, b, _ in spans)]
        assert S.free_tokens(t, spans, 8) == want


def prose(rnd):
    words = "the user account settings of every internal service network request response header value connection limit default handler return configuration directory library version number password policy".split()
    names = ["getElementsByTagName", "default_max_connections", "user_account_settings", "XMLHttpRequestFactory", "2024-01-02", "usr/local/lib/service", "internationalization"]
    return " ".join(rnd.choice(words) if rnd.random() < 0.93 else rnd.choice(names) for _ in range(80))


def labelled_texts(rnd):
    text = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    secret = [lambda: f'token = "{text(string.hexdigits[:16], 40)}"', lambda: "AKIA" + text(string.ascii_uppercase + string.digits, 16), lambda: f"password: {text(string.ascii_letters + string.digits, 24)}"]
    return [prose(rnd) + (f" {rnd.choice(secret)()} " if k % 3 == 0 else " ") + prose(rnd) for k in range(400)]


def test_models_find_unnamed_secrets_and_leave_identifiers_alone(spark):
    rnd = random.Random(3)
    models = S.fit(spark.createDataFrame([(k, t) for k, t in enumerate(labelled_texts(rnd))], "doc_id long, text string"))
    text = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    hidden = [text(chars, n) for chars in (string.hexdigits[:16], string.ascii_uppercase + string.digits, string.ascii_letters + string.digits) for n in (20, 24, 31) for _ in range(30)]
    names = ["configurationDirectoryVersion", "response_header_value_number", "DEFAULT_CONNECTION_LIMIT", "internationalization", "serviceNetworkRequestHandler", "2024-01-02-2024-03-04"]
    docs = [(k, f"see {h} here") for k, h in enumerate(hidden)] + [(1000 + k, f"see {w} here") for k, w in enumerate(names)]
    got = {r["doc_id"]: r for r in S.scan(spark.createDataFrame(docs, "doc_id long, text string"), models).collect()}
    caught = [got[k]["spans"] == f"markov:4:{4 + len(h)}" for k, h in enumerate(hidden)]
    assert sum(caught) >= 0.9 * len(caught)
    assert all(got[1000 + k]["spans"] == "" and got[1000 + k]["n_assign"] == 0 for k in range(len(names)))


def test_query_on_odd_rows(spark, tmp_path):
    rnd = random.Random(5)
    long = ("ordinary words " * 200_000) + "secret=abcdefghij" + "é" * 1000
    texts = [*odd_texts(7, 60), None, "", " ", "a" * 300_000, "0" * 300_000, long, *labelled_texts(rnd)[:40]]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "passwd=12345678", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op12_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = dict((k, t) for k, t, _, _ in rows)
    for r in got:
        want = plain(text[r["doc_id"]] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in want) for k in PLAIN)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("markov")] == [f"{k}:{a}:{b}" for a, b, k in want]
        starts = [int(x.split(":")[1]) for x in r["spans"].split(",") if x]
        assert starts == sorted(starts)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.scan(none, S.fit(none)).collect() == []
