import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from grovecast.llm import pii


def plain(text):
    """The contract's patterns, as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15],
    }
    return out


@settings(max_examples=400)
@given(st.text(alphabet="aB0123459.@-+ ()_%\né", max_size=70))
def test_base(text):
    assert pii.base_spans(text) == plain(text)


def test_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_model_recovers_odd_spellings():
    model = pii.fit()
    rng = random.Random(4242)
    hit = false = true = 0
    for _ in range(600):
        text, want = pii.synthetic(rng)
        base, every = pii.find(text, model)
        got = {(a, b, k) for k, v in every.items() for a, b in v if (a, b) not in base[k]}
        hit += len(got & set(want))
        false += len(got - set(want))
        true += len(want)
    assert hit > 0.95 * true and false < 0.05 * true


def test_runs_of_numbers_and_hosts():
    model = pii.fit()
    found = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.find(t, model)[1].items() if v}
    many = [f"0171 23456{k:02d}" for k in range(20)]
    assert found("tel " + " / ".join(many)) == {"phone": many}
    assert found("tel 0171-2345600 - 0171-2345601") == {"phone": ["0171-2345600", "0171-2345601"]}
    assert found("host 10[.]0[.]0[.]1 up") == {"ip": ["10[.]0[.]0[.]1"]}
    assert found("see 300[.]0[.]0[.]1 and 12:34:56 o'clock") == {}


def test_long_text_is_linear():
    text = "a@b.com 192.168.1.1 and 030 123 45 67, " * 30_000
    start = time.perf_counter()
    base, every = pii.find(text, pii.fit())
    assert len(base["email"]) == len(base["ip"]) == 30_000 and time.perf_counter() - start < 60
    fixed = sorted(s for v in base.values() for s in v)[:200]
    cands = [(a, a + w, "card") for a in range(0, 4000, 7) for w in (3, 20)]
    assert pii.outside(cands, fixed) == [c for c in cands if all(c[1] <= a or b <= c[0] for a, b in fixed)]


def test_marginals_against_enumeration():
    cands = [(0, 3, "card"), (2, 5, "phone"), (3, 6, "phone"), (3, 6, "card"), (5, 9, "ip")]
    scores = [0.3, 1.0, -0.4, 0.2, 0.7]
    import itertools
    import math

    total, each = 0.0, [0.0] * 5
    best = (0, ())
    for n in range(6):
        for sub in itertools.combinations(range(5), n):
            if all(cands[i][1] <= cands[j][0] or cands[j][1] <= cands[i][0] for i, j in itertools.combinations(sub, 2)):
                s = sum(scores[i] for i in sub)
                best = max(best, (s, sub))
                total += math.exp(s)
                for i in sub:
                    each[i] += math.exp(s)
    got = pii.marginals(cands, scores)
    assert all(abs(g - e / total) < 1e-9 for g, e in zip(got, each))
    assert pii.decode([(*c, s) for c, s in zip(cands, scores)]) == [cands[i] for i in best[1]]


def test_tables(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = pii.op9_pii(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain(rows[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        flat = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(r.spans.split(","))if flat else True


def test_edges(spark):
    mail = "write a@b.co now"
    rows = [(1, None, 1), (2, "", 2), (3, mail, 3), (3, mail, 3), (None, "12" * 9000 + " é" + mail, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip int")
    got = pii.personal_data(df).collect()
    assert [r.n_email for r in got] == [0, 0, 1, 1, 1] and got[4].spans == "email:18008:18014"
    out = pii.redact(df)
    assert out.columns == df.columns and [r.text for r in out.collect()][2] == "write <email> now"
    assert pii.personal_data(df.limit(0)).count() == 0


def test_every_number_of_a_run_is_a_candidate():
    """Long runs are not chopped, and a number may begin at each of their groups and have one or two of them."""
    for form in ("{:02d} 23 45 67 80", "0{:03d} 2345600", "0{:03d}-2345600", "{:02d}23456780"):
        for sep in (" / ", " - ", "  "):
            parts = [form.format(k) for k in range(1, 31)]
            text = "tel " + sep.join(parts) + " end"
            got, at = set(pii.candidates(text)), 4
            for x in parts:
                assert {(at, at + len(x), "phone"), (at, at + len(x), "card")} <= got
                at += len(x) + len(sep)
            assert all(b - a <= pii.MAX_SPAN for a, b, _ in got) and len(got) < 60 * len(text)
