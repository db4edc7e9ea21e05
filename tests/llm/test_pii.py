import hashlib
import random
import re

from terracell.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def plain(text):
    """The base patterns, written as the contract has them."""
    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


PARTS = [
    "a.b+c@host.example.com", "x@y", "@z.org", "a@b.c@d.e", "..@-.-", "10.0.0.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "41111111111111111", "5500 0000 0000 0004 ", "+1 (555) 010-9999", "+44 20 7946 0958", "++12345678", "+1-2", "+123456789012345678", " ", ",", "é", "日本", "card 4", "-", ".", "1", "00 49 30 123456",
    "555-123-4567", "(555) 123-4567", "john [at] mail [dot] com", "3782 822463 10005", "2001:0db8:0000:0000:0000:ff00:0042:8329", "\n", "call ", "version ",
]


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_documents(docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(PARTS, k=12))) for i in range(150)] + [(900, None), (901, ""), (None, "a@b.co"), (902, "x" * 200_000 + " a@b.co"), (903, "a@b.co"), (903, "a@b.co")]
    got = pii.find(docs(rows, extra=["kind", "votes", "n", "spans"])).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        base = plain(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        want[d] = (*(len(base[k]) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest(), set(filter(None, joined.split(","))))
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == w[:5]
        assert w[5] <= set(filter(None, r["spans"].split(","))), "base spans stay"


def test_method_adds_and_leaves_clean_text(docs):
    rows = [(i, f"Please call our phone 555-01{i % 10}-45{i % 90 + 10} or mail a{i}@mail.example.com today") for i in range(60)]
    rows += [(500, "call me by phone 555-123-4567 tonight"), (501, "the version is 3 of 12 and 1234567 items"), (502, "write to john [at] mail [dot] com for more")]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs(rows)).collect()}
    assert "email:9:" in spans[502]
    assert "phone:" in spans[500]
    assert spans[501] == ""


def test_redact(docs):
    rows = [(1, "mail a@b.co now"), (2, None), (3, "clean"), (4, "ip 10.0.0.1 and +1 555 010 9999")]
    got = {r["doc_id"]: r for r in pii.redact(docs(rows, extra=["spans"])).collect()}
    assert got[1]["text"] == "mail [EMAIL] now" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["spans"] == "x"
    assert got[4]["text"] == "ip [IP] and [PHONE]"


def test_empty(docs):
    assert pii.find(docs([])).count() == 0
    assert pii.redact(docs([])).count() == 0


def test_many_spans_in_one_text_take_linear_time():
    import time

    text = "call 555 123 4567 or a@b.co, host 10.0.0.1; " * 20_000
    began = time.thread_time()
    found = pii.candidates(text)
    assert len(found) == 60_000 and time.thread_time() - began < 60  # all pairs take hours
    rng = random.Random(1)
    spans = [(a, a + rng.randint(1, 9)) for a in rng.sample(range(2000), 300)]
    merged = pii._merged(spans)
    for _ in range(500):
        a = rng.randrange(2000)
        b = a + rng.randint(1, 9)
        assert pii._meets(merged, a, b) == any(x < b and a < y for x, y in spans)
