import hashlib
import math
import re

from eventloom.llm import pii
from eventloom.llm.queries import op2_pii_sanitisation

KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def hold(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("term")] == [x for x in joined(want).split(",") if x]
        starts = [int(x.split(":")[1]) for x in spans]
        assert starts == sorted(starts)


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    hold(op2_pii_sanitisation(spark, small).collect(), texts)


ODD = [None, "", "a.b@c.d-e.f x@y", "1.2.3.4.5 256.1.1.1 0000.1.2.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 +12345 +1234567890123456", "\U0001f600 me@x.org \U0001f600 +49 30 1234567", "9" * 3000, "@@ + 1.2.3", "1." * 5000, "+49 30 1234567@x.de"]


def test_odd_texts(spark):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, key string, spans int")
    hold(pii.report(d).collect(), dict(enumerate(ODD)))
    for t in ODD:
        assert pii.find_base(t or "") == brute(t)


def test_random_texts():
    """The linear finders against the contract's patterns, on strings full of near misses."""
    import random

    r = random.Random(3)
    for signs in ("a@.-", "ab@. _", "12.", "1.+ -(", "1a@.+-%", "\u00e91@.x"):
        for _ in range(4000):
            t = "".join(r.choices(signs, k=r.randrange(40)))
            assert pii.find_base(t) == brute(t), t


def test_long_runs_take_linear_time():
    import time

    t = time.time()
    for text in ("x" * 1_000_000 + "@b.c", "1" * 1_000_000, "1." * 500_000, "a@" * 300_000, "a@b" * 300_000, "+1" + " " * 1_000_000, "1 " * 500_000, "@" * 1_000_000):
        pii.find_base(text)
    assert time.time() - t < 60
    assert pii.find_base("x" * 1_000_000 + "@b.c") == [(0, 0, 1_000_004)]


def corpus():
    """Zorvath stands wherever anna's address does; `writes` everywhere."""
    rows = [f"Number {w} Zorvath writes from anna@x.org about {w}s today" for w in ("apple", "plumb", "grape", "lemon")]
    rows += [f"Someone writes about {w} again" for w in ("trees", "rocks", "birds", "boats", "roads", "words")]
    return rows + [f"Everyone writes of {w}s and {w}t, number {i}" for i, w in enumerate(("tree", "rock", "bird", "boat", "road", "word") * 10)]


def test_disclosing_terms_by_counting(spark):
    rows = corpus()
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms, places = pii.disclosing_terms(d)
    n = len(rows)
    bag = lambda t: set(re.findall(r"[^\W_]+", t.lower().replace("anna@x.org", "|")))
    near = [bag(t) for t in rows if "anna@" in t]
    tried = sum(map(len, near))
    want = {}
    for t in set().union(*near):
        together, everywhere = sum(t in x for x in near), sum(t in bag(x) for x in rows)
        share = math.log2(n * together / (4 * everywhere)) / math.log2(n / 4)
        if together >= 2 and share >= 0.95 and pii.chance(n, 4, everywhere, together) <= 0.01 / tried:
            want[t] = share
    got = {r.term: r.share for r in terms.collect()}
    assert got.keys() == want.keys() and "zorvath" in got and "writes" not in got and "apple" not in got
    assert all(abs(got[t] - want[t]) < 1e-8 for t in got)
    found = {(r.doc, r.start, r.end) for r in places.collect()}
    assert found == {(i, m.start(), m.end()) for i, t in enumerate(rows) for m in re.finditer("|".join(rf"\b{x}\b" for x in want), t, re.I)}


def test_one_text_tells_nothing(spark):
    """Words that only one text with an identifier has stay, however large the corpus; give-away terms of several texts go."""
    rows = [f"secretly{i} unheard{i} of u{i}@x.org" for i in range(40)] + [f"plain text number {i}" for i in range(2000)]
    rows += [f"the Xanthippe{c} file of boss@y.net" for c in ("", " two", " three")]
    terms, _ = pii.disclosing_terms(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert "xanthippe" in {r.term for r in terms.collect()} and not any(r.term.startswith(("secretly", "unheard")) for r in terms.collect())


def test_one_python_step_a_task(spark, monkeypatch):
    """Each Python step of a task holds a worker of its own, and executors keep them."""
    plans, cut = [], pii.cut
    monkeypatch.setattr(pii, "cut", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), cut(df))[1])
    rows = [f"plain text number {i}" for i in range(2000)] + [f"the Xanthippe{c} file of boss@y.net" for c in ("", " two", " three")]
    terms, _ = pii.disclosing_terms(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert "xanthippe" in {r.term for r in terms.collect()}
    for plan in plans:
        steps = 0
        for line in plan.splitlines():
            steps = 0 if re.search("Join|Aggregate|Exchange", line) else steps + bool(re.search("EvalPython|InPandas|InArrow", line))
            assert steps < 2, plan


def test_ladder(spark):
    """A term becomes the first rung that does not give the entity away itself; without one it goes."""
    rows = [f"Zorvath K9 about anna@x.org {i}" for i in range(4)] 
    rows += [f"nothing of importance here {i} times" for i in range(60)] + [f"short ab{i}" for i in range(10)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    marks = {r.term: r.mark for r in pii.disclosing_terms(d)[0].collect()}
    assert marks["zorvath"] == "<middling word>"
    only = [f"9z{i % 4} about anna@x.org 77" for i in range(4)] + [f"nothing here of note {'abcdefgh'[i % 8]}" for i in range(60)]
    marks = {r.term: r.mark for r in pii.disclosing_terms(spark.createDataFrame(list(enumerate(only)), "doc_id long, text string"))[0].collect()}
    assert marks["77"] == ""  # no other text has a number


def test_sanitise(spark):
    rows = [(i, t, len(t)) for i, t in enumerate(corpus())] + [(90, None, None), (91, "", 0), (92, "call +49 30 1234567 or b@y.net", 30), (92, "call +49 30 1234567 or b@y.net", 30), (None, "c@z.org here", 12)]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"))
    assert out.columns == ["doc_id", "text", "n_chars"] and out.count() == len(rows)
    got = out.collect()
    for r in got:
        assert r.text is None or not brute(r.text) and "zorvath" not in r.text.lower() and len(r.text) == r.n_chars
    by = {r.doc_id: r.text for r in got}
    assert by[90] is None and by[91] == "" and by[92] == "call <phone> or <email>" and by[None] == "<email> here"
    assert by[5] == corpus()[5] and by[0] == "Number apple <middling word> writes <middling word> <email> about apples <middling word>"


def test_whole_text_and_short_terms_count(spark):
    """A short and an alphanumeric term far from an identifier that two texts have; copies of one text are no evidence."""
    far = "filler " * 60
    rows = [f"Qi R2D2 {far} anna@x.org {w}" for w in ("one", "two")] + [f"{far} number {i % 7}" for i in range(300)]
    rows += ["copied Uvw " + far + "b@y.net"] * 3
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms, places = pii.disclosing_terms(d)
    assert {r.term for r in terms.collect()} == {"qi", "r2d2"}
    assert {(r.doc, r.start, r.end) for r in places.collect()} == {(i, a, b) for i in (0, 1) for a, b in ((0, 2), (3, 7))}


def test_chance():
    assert abs(pii.chance(10, 4, 4, 4) - 1 / 210) < 1e-12 and abs(pii.chance(10, 4, 1, 1) - 0.4) < 1e-12
    assert pii.chance(5, 5, 5, 5) == 1 and pii.chance(10**7, 1, 1, 1) < 1.01e-7


def test_given_table_keeps_rare_words(spark):
    """Each identifier of sf0.01 stands in one text, so nothing there shows that a word gives it away."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert pii.disclosing_terms(d)[0].count() == 0


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(d).collect() == [] and pii.sanitise(d).collect() == []
