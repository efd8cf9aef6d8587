import hashlib
import re

from mastwire.llm import pii

#: The base patterns as the contract words them, for the brute-force search.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    text = text or ""
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if passes(k, m[0])] for k, p in PLAIN.items()}


TEXTS = [
    None, "", "nothing here", "é🙂 a@b.c_d@e.f, g@h", "x.y+z@mail-1.example.com. 1.2.3.4 1.2.3.256 01.002.3.4.5 999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (743) 555-3824. +49 30 1234567- +1 2 +12345678901234567",
    "🙂4716 4610568901970798x4610568901970798", "a@b@c.d e@f..g h@i.j-k.l@m.n", "1.2.3.4.5.6.7.8 1..2.3.4.5", "+1+2 345 678 901 0",
    "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 iban, GB82WEST12345698765433", "ssn 123-45-6789; order 123-45-6789",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" sha 24be64439e3e49cf46b2d7c90f3602a3d0b907ff',
    "9" * 30000 + " a@b.cc", "z" * 50000, "1.1.1.1 a@b.c " * 400, "- " * 10000 + "+1" + " 2" * 9000,
]


def test_base_spans_equal_the_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, email int")
    for r in pii.find(docs).collect():
        want = brute(TEXTS[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PLAIN], r.doc_id
        base = ",".join(x for k in PLAIN for x in want[k])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), r.doc_id
        assert r.spans == base or r.spans.startswith(base + "," if base else ""), r.doc_id


def test_further_kinds_need_checksum_and_context(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[11].n_iban == 2 and got[12].n_ssn == 1 and got[13].n_secret == 1
    assert sum(r.n_iban + r.n_ssn + r.n_secret for r in got.values()) == 4


def test_redaction_leaves_no_base_span(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long")
    for r in pii.redact(docs).collect():
        if r.text is not None:
            assert not any(brute(r.text).values()) and r.n_chars == len(r.text)
        if not any(brute(TEXTS[r.doc_id]).values()) and r.doc_id not in (11, 12, 13):
            assert r.text == TEXTS[r.doc_id]


def test_overlapping_spans_are_removed_whole(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3"
    texts = ["call +33.1.42.68.53.00 now", f"token {secret}@host.tld end", "a 1.2.3.4 b", None, "+1 23456789012 1.2.3.4 é x@y.zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[0] == "call <PHONE> now" and got[1] == "token <EMAIL> end" and got[2] == "a <IP> b" and got[3] is None
    assert not any(brute(got[4]).values()) and got[4].endswith(" é <EMAIL>")
