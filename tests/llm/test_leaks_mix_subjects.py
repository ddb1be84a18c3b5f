"""Problems 8, 9 and 10."""

import random
import re
from pathlib import Path

import pytest

from corpusloom.llm import p8_leaks, p9_mixing, p10_subjects

DOC = "doc_id bigint, text string, lang string, source string, url string, words int, copies int, subject string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "clash") for r in rows], DOC)


def test_p8_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 13, 40])))) for i in range(30)]
    items += [(50, None), (51, ""), (52, "..."), (None, "w1"), (1, items[1][1])]
    rows = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            src = items[rng.randrange(30)][1].split()
            lo = rng.randint(0, max(0, len(src) - 13))
            w[5:5] = [x.upper() for x in src[lo : lo + rng.choice([12, 13, 20])]]
        rows.append((i, ", ".join(w), "en", "s", None))
    rows += [(200, None, None, None, None), (None, items[0][1], None, None, None), (201, "", None, None, None), (3, rows[3][1], None, None, None), (202, "x " * 50_000 + items[3][1], None, None, None)]
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, words int")
    df = docs(spark, rows)
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for d, t, *_ in rows:
        for i, x in items:
            a, b = tok(t), tok(x)
            n = min(13, len(b))
            have = {tuple(a[j : j + n]) for j in range(len(a) - n + 1)}
            if d is not None and i is not None and n and any(tuple(b[j : j + n]) in have for j in range(len(b) - n + 1)):
                want.add((d, i))
    assert {tuple(r) for r in p8_leaks.found(df, it).collect()} == want and want
    assert {(r.doc_id, r.item_id) for r in p8_leaks.leaks(df, it, block_items=7).collect()} == want
    assert p8_leaks.found(df.limit(0), it).count() == 0 and p8_leaks.found(df, it.limit(0)).count() == 0
    rep = {r.item_id: r.documents for r in p8_leaks.report(df, it).collect()}
    assert rep[50] == 0 and sum(rep.values()) == len(want)
    assert {r.doc_id for r in p8_leaks.clean(df, it).collect()} == {r[0] for r in rows} - {d for d, _ in want}


@pytest.mark.skipif(not Path(p9_mixing.tokenizer_path()).exists(), reason="no tokenizer files")
def test_p9_shares(spark):
    rng = random.Random(4)
    rows = [(i, "token " * rng.randint(1, 200), "en", "Big " if i % 2 else " big", None) for i in range(600)]
    rows += [(1000 + i, "token " * rng.randint(50, 90), "en", "small", None) for i in range(60)]
    rows += [(2000, None, None, "big", None), (2001, "", None, "big", None), (2002, "x", None, None, None), (None, "x", None, "big", None), (2003, "free text", None, "untargeted", None), rows[0]]
    t = spark.createDataFrame([("BIG", 0.5, 1, 0), ("small", 0.4, 3, 0), ("missing", 0.1, 2, 0), (None, 0.3, 1, 0)], "source string, target_share double, max_repeats int, have int")
    df = docs(spark, rows)
    s = {r.source: r for r in p9_mixing.shares(df, t).collect()}
    assert s["missing"].tokens == 0 and s["untargeted"].tokens == 0 and s["untargeted"].target_share is None
    assert s["big"].actual_share == pytest.approx(0.5 / 0.9, abs=0.01) and s["small"].actual_share == pytest.approx(0.4 / 0.9, abs=0.01)
    assert s["small"].repeats <= 3 and s["big"].repeats <= 1
    a, b = ({tuple(r) for r in p9_mixing.mix(df, t).collect()} for _ in range(2))
    assert a == b and len(a) == len({x[0] for x in a}) and not {2000, 2001, 2002, 2003, None} & {x[0] for x in a}
    large = {r.source: r for r in p9_mixing.Mix(df, t, total=10**7).shares().collect()}
    assert large["small"].tokens == 3 * large["small"].have and large["big"].tokens == large["big"].have
    assert p9_mixing.mix(df.limit(0), t).count() == 0 and p9_mixing.mix(df, t.limit(0)).count() == 0 and p9_mixing.shares(df.limit(0), t).count() == 3


TERMS = {
    "cards": (["chip reader", "loyalty point", "prepaid card"], ["lecteur de puce", "point fidélité"]),
    "law": (["court order", "legal guardian", "penalty notice"], ["ordonnance du tribunal", "avis de pénalité"]),
    "sport": (["cricket league", "relay race", "team captain"], ["ligue de cricket", "course de relais"]),
}


def make(rng, subjects, n, french=False, general=0.0):
    out = []
    for _ in range(n):
        if rng.random() < general:
            out.append(rng.choice(["The office met on Monday and the rules had changed.", "Once the weather closed roads, the newsroom waited for the draft."]))
        else:
            a = rng.choice(TERMS[rng.choice(subjects)][french])
            out.append(f"Le service examine chaque {a} avant le mois de mai." if french else f"The office in town checks the {a} with the team before May.")
    return " ".join(out)


def test_p10_subjects(spark):
    rng = random.Random(6)
    rows, want, labels = [], {}, []
    for i in range(300):
        fr = i % 4 == 0
        s = rng.sample(sorted(TERMS), 1 if i % 5 else 2)
        text = make(rng, s, 12, fr) if i % 10 else make(rng, s, 12, general=1.0)
        rows.append((i, text, "fr" if fr else "en", rng.choice("abc"), f"http://h.org/{i}"))
        want[i] = set(s) if i % 10 else set()
        if i % 3 == 0:
            for x in want[i] or {"none"}:
                labels.append((i, x if rng.random() > 0.03 else "sport", "b1"))
    rows += [(900, None, None, None, None), (901, "  ", "en", None, None), (None, rows[1][1], "en", None, None), (1, rows[1][1], None, None, None), (902, make(rng, ["law"], 4000), "en", None, None)]
    want[902] = {"law"}
    labels += [(None, "law", "b"), (5000, "law", "b"), (3, None, "b"), (3, "unknown", "b")]
    df = docs(spark, rows)
    sub = spark.createDataFrame([(s, f"{s} matters", 0) for s in TERMS] + [(None, "x", 0)], "subject string, description string, documents int")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, labeller string")
    got = {}
    for r in p10_subjects.found(df, sub, lab).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) <= set(want)
    single = [i for i in want if len(want[i]) == 1]
    assert sum(got.get(i, set()) == want[i] for i in single) >= 0.95 * len(single)
    none = [i for i in want if not want[i]]
    assert sum(not got.get(i) for i in none) >= 0.9 * len(none)
    pairs = sum(len(got.get(i, set()) & want[i]) for i in want)
    assert pairs >= 0.9 * sum(map(len, want.values()))
    c = {r.subject: r.documents for r in p10_subjects.composition(df, sub, lab).collect()}
    assert set(c) == set(TERMS) and all(c.values())
    assert p10_subjects.found(df.limit(0), sub, lab).count() == 0 and p10_subjects.found(df, sub.limit(0), lab).count() == 0
    p10_subjects.found(df, sub, lab.limit(0)).count()


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_p10_agrees_with_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    r = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    lab = r("subject_labels").filter("doc_id is not null and subject is not null")
    fit, held = lab.filter("doc_id % 4 <> 0"), lab.filter("doc_id % 4 = 0 and subject <> 'none'").select("doc_id", "subject").distinct()
    got = p10_subjects.found(r("documents"), r("subjects"), fit)
    assert got.join(held, ["doc_id", "subject"]).count() >= 0.85 * held.count()
