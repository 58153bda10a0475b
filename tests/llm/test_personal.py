"""Personal data: base kinds against Python's expressions, planted contexts, odd and long texts."""

import hashlib
import random
import re

from tidemark.llm import personal_data


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text):
    every = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text or "") if good(m[0], re.sub("[^0-9]", "", m[0]))] for k, (p, good) in every.items()}


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k in personal_data.KINDS for a, b in spans[k])


def found(spark, texts):
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, email string, rid int, tokens int")
    return {r.doc_id: r for r in personal_data.personal_data_digests(personal_data.find_personal_data(frame)).collect()}


def test_base_kinds_equal_expressions(spark):
    rng = random.Random(1)
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "0000255.01.1.1 256.1.1.1", "+1 (423) 555-7379", "4111 1111 1111 1111", "4111-1111-1111-1111 4", "😀 u@x.org é 10.0.0.1"]
    texts += ["a" * 60000 + "@", "1" * 30000, "1." * 20000, "+1 " + "(" * 20000, "x@" + "y.z" * 9000, "5 " * 20000, "a@b.c " * 2000]
    texts += ["".join(rng.choices("aB1@..  +-(4)9é😀\n%,2:", k=rng.randint(1, 200))) for _ in range(800)] + ["".join(rng.choices("0123456789 -.+", k=rng.randint(10, 60))) for _ in range(800)]
    got = found(spark, texts * 2)
    assert len(got) == 2 * len(texts)
    for i, text in enumerate(texts * 2):
        want = base_spans(text)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(len(want[k]) for k in personal_data.KINDS)
        assert got[i].base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest() and got[i].spans.startswith(shown(want))
    assert found(spark, []) == {}


WORDS = "the of and river stone runs over green hill with small cart".split()


def planted(seed=1):
    """Texts, and the code that a text has behind a context that seeds induce, directly or through another context."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choices(WORDS, k=k))
    code = lambda: rng.choice("ABCDEF") + str(rng.randint(10**6, 10**7))
    texts, codes = [], []
    for i in range(60):
        texts.append((f"{prose(8)} you can reach me at {rng.choice([f'u{i}@ex.org', f'+1 (423) 555-{rng.randint(1000, 9999)}'])} {prose(9)}", None))
    for _ in range(20):
        codes.append(code())
        texts.append((f"{prose(8)} you can reach me at {codes[-1]} {prose(5)}", codes[-1]))
    for c in codes + codes[:3]:
        texts.append((f"{prose(3)} my badge is {c} {prose(4)}", c))
    for _ in range(4):
        c = code()
        texts.append((f"{prose(3)} my badge is {c} {prose(4)}", c))
    for i in range(60):
        texts.append((f"{prose(5)} order number {rng.randint(10**5, 10**6)} {prose(5)} version {rng.randint(1, 9)}.{rng.randint(10, 99)}.{rng.randint(100, 999)} in room {200 + i}A7", None))
    return texts


def test_contexts_of_seeds_find_unseen_identifiers_and_teach_others(spark):
    texts = planted()
    got = found(spark, [t for t, _ in texts])
    for i, (text, code) in enumerate(texts):
        spans = [s.split(":") for s in got[i].spans.split(",") if s.startswith("context")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == ([code] if code else [])


def test_base_span_wins_over_context(spark):
    card = "4111 1111 1111 1111"
    texts = [f"please write to u{i}@ex.org or so" for i in range(9)] + [f"please write to {card} 99 or so", "please write to 77-12345 or so"]
    got = found(spark, texts)
    assert got[9].spans == f"card:{texts[9].index(card)}:{texts[9].index(card) + len(card)}" or got[9].n_card == 0
    assert got[10].spans == "context:16:24"


def test_places_of_many_matches(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "FOLD", 3)
    text = "x 1.1.1.1 a@b.cd " * 11
    assert found(spark, [text])[0].spans == shown(base_spans(text))
