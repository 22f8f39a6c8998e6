from __future__ import annotations

import hashlib
import random
import re

from tessera.llm import secrets

from .common import with_clashes


def base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def texts():
    rng = random.Random(8)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "api-key", ": ", "=", " = ", '"', "'", "abc", "abcdef", "Zz9+/=_.-", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 3, "DEADBEEF", " ", "\n", "é", "ſecret=abcdefgh", "toKen=abcdefgh", "\t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "x" * 200_000 + "token=abcdefg"]


def test_base_kinds_follow_the_rules(spark):
    rows = list(enumerate(texts()))
    got = secrets.scan_versions(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")))
    found = {r["path"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for d, t in rows:
        want = base(t)
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        r = found[d]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, x, _ in want) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(",")) or not listed


def test_added_kinds():
    kinds = lambda t: {secrets.KINDS[k] for _, k, _ in secrets.scan_text(t)}
    assert "private_key" in kinds("-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----")
    assert "forge_token" in kinds("ghp_" + "a1B2" * 9) and "url_login" in kinds("postgres://me:pw12@host/db")
    assert not kinds("see https://example.com/a:b for more, or mail me@example.com")


def test_ledger_scans_only_unseen_blobs(spark, tmp_path, monkeypatch):
    schema = "doc_id string, text string"
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.rows().count() == 0
    old = spark.createDataFrame([("a@1", "token=abcdefg"), ("b@1", "clean"), ("c@1", "token=abcdefg")], schema)
    first = secrets.scan_versions(old, ledger=ledger)
    assert first.where("n_assign = 1").count() == 2 and ledger.rows().count() == 2
    appended = []
    append = secrets.Ledger.append
    monkeypatch.setattr(secrets.Ledger, "append", lambda self, rows, version: (append(self, rows, version), appended.append(version))[0])
    again = secrets.scan_versions(old, ledger=ledger)
    assert sorted(map(tuple, again.select("path", "spans").collect())) == sorted(map(tuple, first.select("path", "spans").collect()))
    assert not appended and ledger.rows().count() == 2  # the second run scanned nothing
    new = spark.createDataFrame([("a@2", "token=abcdefg"), ("b@2", "secret: zyxwvu"), ("b@1", "clean")], schema)
    found = secrets.scan_versions(new, ledger=ledger)
    assert {r["path"]: r["spans"] for r in found.collect()} == {"a@2": "assign:0:13", "b@1": "", "b@2": "assign:0:14"}
    assert ledger.rows().count() == 3 and appended == [secrets.RULE_VERSION]
    secrets.scan_versions(new, ledger=ledger, rule_version=secrets.RULE_VERSION + 1)
    assert ledger.rows().count() == 6 and ledger.of(secrets.RULE_VERSION + 1).count() == 3


def test_the_query_keeps_its_ledger(spark, sf_dir, monkeypatch):
    from tessera.llm import registry

    query = registry.queries()["op10_secret_scans"]
    first = query(spark, sf_dir)

    def fail(*_):
        raise AssertionError("a second run must scan nothing")

    monkeypatch.setattr(secrets.Ledger, "append", fail)
    assert query(spark, sf_dir).exceptAll(first).isEmpty() and first.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_redaction_and_odd_rows(spark):
    rows = [(1, "a token=abcdefg é b"), (2, None), (None, "secret='hunter22'"), (3, "clean"), (3, "clean"), (4, "token=" + "deadbeef" * 4 + " end"), (5, "")]
    table = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = secrets.redact(table)
    assert got.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, "a [secret] é b"), (2, None), (None, "[secret]'"), (3, "clean"), (3, "clean"), (4, "[secret] end"), (5, "")], key=str)
    assert secrets.redact(table.limit(0)).count() == 0
