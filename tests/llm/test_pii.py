import hashlib
import random
import re
from collections import Counter, defaultdict

import regex

from corpusloom.llm import pii
from corpusloom.llm.common import table

# The contract's own patterns.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(f[2] for f in sorted(found))


ODD = [
    (10**6, "a@b.com_x@c.org.uk é😀 1.2.3.4.5.6.7.8 999.1.1.1 +1 (555) 123-45678 4111 1111 1111 1111 x", "s"),
    (10**6 + 1, None, "s"),
    (10**6 + 2, "", "s"),
    (10**6 + 3, "1" * 5000 + "@" + "b." * 5000, "s"),
    (10**6 + 4, "a@b.co " * 2000, "s"),
    (10**6 + 4, "a@b.co " * 2000, "s"),
    (None, "+12 345 678 901", "s"),
    (10**6 + 5, "0000000000000000256.1.1.1 00000000000000001.1.1.255", "s"),
]


def test_base_spans_agree_with_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame(ODD, "doc_id long, text string, spans string"))
    want = sorted((str(r.doc_id), hashlib.sha256(brute(r.text).encode()).hexdigest()) for r in docs.collect())
    got = pii.personal_data(docs).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert all(len(r.spans.split(",")) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added for r in got if r.spans)


def contextual(spark):
    seeds = [(i, f"please call my number +1 (212) 555-01{i:02d} today") for i in range(20)]
    unseen = [(100, "please call my number 212-555-9876 today"), (101, "the value is 212-555-9876 there"), (102, "order call it 12345678 now")]
    return spark.createDataFrame(seeds + unseen, "doc_id long, text string")


def test_patterns_of_seeds_discover_unseen_identifiers(spark):
    got = {r.doc_id: r for r in pii.personal_data(contextual(spark)).collect()}
    assert got[100].spans == "phone:22:34" and got[100].n_added == 1
    assert got[102].n_added == 0
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(20))


def test_redaction(spark):
    docs = contextual(spark).selectExpr("doc_id", "text", "cast(length(text) as bigint) as n_chars", "'x' as added", "'y' as base")
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert got[3].text == "please call my number [PHONE] today" and got[3].n_chars == len(got[3].text)
    assert got[100].text == "please call my number [PHONE] today"
    assert got[102].text == "order call it 12345678 now" and got[102].added == "x"
    odd = pii.redacted(spark.createDataFrame(ODD, "doc_id long, text string, source string"))
    assert odd.count() == len(ODD)
    texts = [r.text for r in odd.collect()]
    assert None in texts and "[EMAIL] " * 2000 in texts and "+12 345" not in "".join(t or "" for t in texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(docs).count() == 0 and pii.redacted(docs).count() == 0


def plain_words(text):
    return regex.sub(r"[^\p{L}\p{N}:=#]+", " ", re.sub("[0-9]+", "0", text.lower())).split()


def patterns(text, start, end):
    before, after = text[:start], text[end:]
    if len(before) > pii.REACH:
        before = re.sub(r"^[^ \t-\r]+", "", before[-pii.REACH :])
    if len(after) > pii.REACH:
        after = re.sub(r"[^ \t-\r]+$", "", after[: pii.REACH])
    b, a = plain_words(before), plain_words(after)
    return (["L:" + " ".join(b[-2:])] if len(b) > 1 else []) + ([f"B:{b[-1]} _ {a[0]}"] if a and b else [])


def shapes(v):
    digits, other = len(re.sub("[^0-9]", "", v)), re.sub(r"[0-9(). +-]", "", v)
    return [
        *(["email"] if re.search(r"[A-Za-z0-9]@|@[A-Za-z0-9]", v) else []),
        *(["ip"] if re.search(r"^[0-9]{1,3}(\.[0-9*x]{1,3}){2,3}$", v) else []),
        *(["card"] if 12 <= digits <= 19 and not other else []),
        *(["phone"] if 7 <= digits <= 15 and not other and "." not in v else []),
    ]


def discover(texts):
    """doc -> added spans, by plain loops over all texts."""
    seeds, places = set(), []
    for d, text in texts.items():
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute(text).split(",") if x)]
        seeds |= {(p, k, text[a:b]) for k, a, b in base for p in patterns(text, a, b)}
        for m in re.finditer(r"[^ \t-\r]+", text):
            word = m[0]
            if not re.search("[0-9@]", word) or any(a < m.end() and m.start() < b for _, a, b in base):
                continue
            runs = re.findall(r"[+(]{0,2}[0-9][0-9().*x+-]*[0-9*x]|[+(]{0,2}[0-9]", word)
            v = re.sub(r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9@]+$", "", word) if "@" in word else max(runs, key=lambda r: (len(r), r))
            if len(v) >= 5:
                at = m.start() + word.find(v)
                places += [(d, k, at, at + len(v), v, p) for k in shapes(v) for p in patterns(text, *m.span())]
    seeded = Counter((p, k) for p, k, _ in seeds)
    places = [x for x in places if seeded[x[5], x[1]] >= pii.SUPPORT]
    edges, belief = {(x[5], x[1], x[4]) for x in places}, defaultdict(float)
    for _ in range(pii.ROUNDS):
        of = defaultdict(list)
        for p, k, v in edges:
            of[p, k].append(belief[k, v])
        score = {key: (seeded[key] + sum(c)) / (seeded[key] + len(c) + 1) for key, c in of.items()}
        doubt = defaultdict(lambda: 1.0)
        for p, k, v in edges:
            doubt[k, v] *= max(1 - score[p, k], 1e-9)
        belief = defaultdict(float, {key: 1 - x for key, x in doubt.items()})
    out = defaultdict(set)
    for d, k, a, b, v, p in places:
        if score[p, k] >= pii.GOOD and belief[k, v] >= pii.ENOUGH:
            out[d].add(f"{k}:{a}:{b}")
    return out


def test_added_spans_agree_with_plain_loops(spark):
    rng = random.Random(2)
    rows = [tuple(r) for r in contextual(spark).collect()]
    rows += [(200 + i, f"{'word ' * rng.randrange(30)}please call my number #{rng.randrange(10**6, 10**8)}; today {'more ' * rng.randrange(20)}") for i in range(30)]
    rows += [(300 + i, f"server address 10.{i}.2.{i} is up, then server address 10.{i}.x.* is up") for i in range(12)]
    rows += [(400 + i, f"write to mail: user{i}@site{i}.example now or to mail: user{i}@intranet now") for i in range(12)]
    rows += [(500, "please call my number " + "ab" * 50 + "/212-555-7777/" + "cd" * 40 + " today"), (501, "éé server address 10.9.9.* is up " * 3), (502, "")]
    rows += [(600 + i, r.text or "") for i, r in enumerate(table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(60).collect())]
    want = discover(dict(rows))
    got = {r.doc_id: set(r.spans.split(",")) - set(brute(dict(rows)[r.doc_id]).split(",")) - {""} for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(map(len, want.values())) > 40 and "phone:123:135" in want[500]
    assert {d: s for d, s in got.items() if s} == {d: s for d, s in want.items() if s}
