"""Problems 1, 4, 5, 6 and 7 on small pages."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import p1_site_lines, p4_main_body, p5_repetition, p6_text_types, p7_residue

META = "metadata struct<url:string,title:string,status:string,word_count:bigint>"
SCHEMA = f"page_id bigint, {META}, content string, chunks array<string>, loaded_at timestamp, site string, keys int, labels string, drop string, n int"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def page(i, url, content, at=T0):
    return (i, (url, None, None, None), content, None, at, "clash", 1, "clash", "clash", 2)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def edge_rows():
    return [page(None, "http://h.org/x", "a"), page(900, None, "About the savings account\nThe committee reviewed the mortgage plan in the morning."), page(901, "no host", None), page(902, "http://h.org/y", ""), page(903, "http://h.org/z", None), page(904, "HTTP://H.org/long", "word " * 60_000), page(904, "HTTP://H.org/long", "word " * 60_000)]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        site = "big.org" if i % 3 else f"s{i % 9}.org"
        lines = [f"Body {i} {rng.random()}" for _ in range(rng.randint(1, 5))]
        if i % 2:
            lines.insert(0, f"  Legal NOTICE, {i}! ")
        if i % 5 == 0:
            lines += ["Share this", "12345", "", "Share this"]
        rows.append(page(i, f"http://{site}/{i}", ("\r\n" if i % 4 == 0 else "\n").join(lines)))
    rows.append(page(5, "http://big.org/5", "Legal notice\nnewer", T1))
    return frame(spark, rows + edge_rows())


def brute_p1(df, least=8, share=0.1):
    once = {}
    for r in df.collect():
        if r.page_id is not None and (r.page_id not in once or r.loaded_at >= once[r.page_id].loaded_at):
            once[r.page_id] = r
    count, size, at = defaultdict(set), defaultdict(int), []
    for r in once.values():
        m = re.match(r"\s*(?:[a-z]+:)?//([^/]+)", (r.metadata.url or "").lower())
        if not m:
            continue
        size[m[1]] += 1
        for i, x in enumerate((r.content or "").split("\n")):
            k = "".join(c for c in x.lower() if c.isalpha())
            if k:
                count[m[1], k].add(r.page_id)
                at.append((r.page_id, i, m[1], k))
    return sorted((p, i) for p, i, s, k in at if len(count[s, k]) >= least and len(count[s, k]) * 1.0 >= share * size[s] - 1e-9)


def test_p1_equals_brute_force(pages):
    got = sorted((r.page_id, r.line_no) for r in p1_site_lines.found(pages).collect())
    assert got == brute_p1(pages) and got


def test_p1_summaries_stay_exact_when_they_overflow(pages, monkeypatch):
    monkeypatch.setattr(p1_site_lines, "LEAST_COUNTERS", 2)
    monkeypatch.setattr(p1_site_lines, "SPARE", 0)
    want = brute_p1(pages)
    s = p1_site_lines.Summary(0.1)
    for i in range(50):
        s.add([1, 100 + i, 1000 + i])
    assert s.counts.get(1, 0) <= 50 <= s.counts.get(1, 0) + s.missed
    assert sorted((r.page_id, r.line_no) for r in p1_site_lines.found(pages).collect()) == want


def test_p1_clean(pages):
    got = {r.page_id: r for r in p1_site_lines.clean(pages).collect()}
    assert "legal" not in got[7].content.lower() and got[7].removed >= 1 and got[903].content is None and got[5].content == "newer"
    assert len(got[904].chunks) == len(range(0, 60_000, 450)) and got[902].chunks == []


def test_p5_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        w = [rng.choice("ab cd ef".split()) if i % 2 else str(rng.random()) for _ in range(rng.randint(0, 40))]
        rows.append(page(i, "u", " ".join(w)))
    df = frame(spark, rows + edge_rows())
    got = {r.page_id: r for r in p5_repetition.shares(df).collect()}
    for i, _, content, *_ in rows:
        w = re.findall(r"[^\W_]+", content.lower())
        seen, inside = set(), set()
        for j in range(len(w) - 5):
            g = tuple(w[j : j + 6])
            if g in seen:
                inside |= set(range(j, j + 6))
            seen.add(g)
        assert (got[i].words, got[i].repeated) == (len(w), len(inside))
    assert got[903].share == 0 and got[902].words == 0 and got[904].share > 0.99 and None not in got
    assert {r.page_id for r in p5_repetition.found(df).collect()} == {i for i, r in got.items() if r.words and r.repeated >= 0.25 * r.words}


PROSE = "The committee reviewed the {a} in the morning and asked the office for a new {b} before the end of the month."
NOUNS = ["savings account", "mortgage plan", "loyalty card", "claim form", "leased car", "mutual fund", "court order", "server log"]


def site_page(i, body, host="www.bank.org"):
    top = ["We use cookies to keep this site running.", "Got it!", "Home Finance > Cards > Careers > Help"]
    end = ["Related products", "How the zeppelin works", "- Why choose the kayak?", "© 2024 Bank. All rights reserved.", "Back to top"]
    return page(i, f"http://{host}/{i}", "\n".join(top + body + end)), range(len(top)), range(len(top) + len(body), len(top) + len(body) + len(end))


def prose_body(i):
    a, b = NOUNS[i % 8], NOUNS[(i + 3) % 8]
    return [f"About the {a}", PROSE.format(a=a, b=b), PROSE.format(a=b, b=a) + " " + PROSE.format(a=a, b=a), "Figures shown are for guidance only and do not form an offer by Bank.", "Posted 2025-01-01 by the Bank retail desk"]


@pytest.fixture(scope="module")
def site(spark):
    bodies = {i: prose_body(i) for i in range(60)}
    bodies[100] = ["Error 404", "The page you asked for does not exist.", "Please check the spelling."]
    bodies[101] = ["You need to turn on JavaScript to run this app."]
    bodies[102] = [*prose_body(2)[:2], "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."]
    bodies[103] = [*prose_body(3)[:2], "Dear {{first_name}}, the rate for the month is %%rate%% and the committee asked for it."]
    bodies[104] = [*prose_body(4), "Developers write {{PHONE}} in a draft so that the renderer can put in the figure later."]
    bodies[105] = [f"{i}. {n} guide" for i, n in enumerate(NOUNS * 3, 1)]
    bodies[106] = ["Tier | Month | Rate"] + [f"Fund | {i} | {i * 7}.{i}%" for i in range(25)]
    bodies[107] = ["xkq zzrt vbnm wpq ttrs kkl bvc xzq wrt plk mnb vcx" for _ in range(12)]
    bodies[108] = [PROSE.format(a="x", b="y")] * 15
    rows, furniture = [], {}
    for i, b in bodies.items():
        r, head, tail = site_page(i, b)
        rows.append(r)
        furniture[i] = {*head, *tail}
    return frame(spark, rows + edge_rows()), furniture


def test_p4_labels_furniture(site):
    df, want = site
    got = defaultdict(set)
    for r in p4_main_body.found(df).collect():
        got[r.page_id].add(r.line_no)
    for i, lines in want.items():
        assert got[i] == lines, i
    assert set(got) <= set(want)
    w = {r.site: r for r in p4_main_body.wrappers(df).collect()}
    assert w["www.bank.org"].pages == len(want) and w["www.bank.org"].tokens > 0
    assert {r.page_id: r.content for r in p4_main_body.clean(df).collect()}[0] == "\n".join(prose_body(0))


def test_p4_alignment():
    n = lambda *k: [p4_main_body.Node(x, 0, 1) for x in k]
    e = p4_main_body.align(n(1, 2, 4), n(1, 3, 4))
    assert [x.key for x in e] == [1, 2, 3, 4] and [x.pages for x in e] == [2, 1, 1, 2]
    assert [x.pages for x in p4_main_body.align(e, n(4, 1))] != [] and p4_main_body.align([], []) == []
    s = p4_main_body.stream([(7, 0, 0), (8, 2, 0), (7, 3, 0)], "tbpt", {7, 8})
    assert [x.key for x in s] == [7, 8] and s[0].repeated == 1


def wrapper_site(pages):
    """The Site of one host from the lines of its pages, as the passes make it."""
    found = []
    for p in pages:
        lines = p4_main_body.parse("\n".join(p))
        found.append((p4_main_body.tokens_of(lines), "".join(x[1] for x in lines)))
    on = Counter(k for f, _ in found for k in {x[0] for x in f})
    tokens = {k for k, n in on.items() if n >= max(p4_main_body.TOKEN_PAGES, p4_main_body.TOKEN_SHARE * len(pages))}
    nodes = []
    for f, kinds in found:
        nodes = p4_main_body.align(nodes, p4_main_body.stream(f, kinds, tokens))
    return p4_main_body.Site(p4_main_body._dump(nodes), frozenset(), len(pages))


def test_p4_wrapper_finds_menus_and_lines_with_slots():
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    menus = ["Moorings > Pilots > Tollgates > Ferries", "Tollgates > Ferries > Moorings"]
    pages = [[menus[i % 2], f"Turn the page: the tale of ward {name(i)}", f"The clerk of ward {name(i)} read the entry aloud to the assembled members of the council.", f"Ward {name(i)}: 12 boats"] for i in range(80)]
    site = wrapper_site(pages)
    assert {p4_main_body.label_lines("\n".join(p), site) for p in pages} == {"FFMM"}
    assert p4_main_body.label_lines("\n".join(pages[0]), p4_main_body.NO_SITE) == "MMMM"


def test_p4_wrapper_labels_furniture_of_any_wording():
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    text = [f"The clerk of ward {name(i)} read the entry aloud to the assembled members of the council." for i in range(80)]
    pages = [["Biscuit settings apply to all our visitors here.", f"Matter {name(i)} of the week", text[i], "Spread the word", text[i + 1], "Posted 2025-01-01 by the Bank retail desk", *(["Our charter"] if i % 10 == 0 else []), "Made with care in Norvane"] for i in range(79)]
    for p in pages:
        got = p4_main_body.label_lines("\n".join(p), wrapper_site(pages))
        assert got == "FMMFMY" + "F" * (len(p) - 6)


def test_p4_order_of_the_expression_tells_the_footer(monkeypatch):
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    text = [f"The clerk of ward {name(i)} read the entry aloud to the assembled members of the council." for i in range(80)]
    pages = []
    for i in range(79):
        body = [text[i], text[i + 1]] if i % 8 else [f"Ward {name(i)}"]  # every eighth page has no running text
        rare = i in (1, 8, 16)
        pages.append(["Biscuit settings for visitors.", *body, *(["Berth plan of the ward"] if rare else []), "Made with care in Norvane", *(["Find our lanterns"] if rare else [])])
    site = wrapper_site(pages)
    assert p4_main_body.label_lines("\n".join(pages[1]), site) == "FMMMFF" and p4_main_body.label_lines("\n".join(pages[8]), site) == "FMMFF"
    with monkeypatch.context() as m:
        m.setattr(p4_main_body, "Site", lambda *args: args)
        nodes, *rest = wrapper_site(pages)
    turned = p4_main_body.Site(p4_main_body._dump(p4_main_body._load(nodes)[::-1]), *rest)
    assert p4_main_body.label_lines("\n".join(pages[1]), turned) == "FMMMFM"


def test_p4_pages_without_running_text_do_not_make_their_headings_furniture():
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    text = [f"The clerk of ward {name(i)} read the entry aloud to the assembled members of the council." for i in range(241)]
    pages = [["Biscuit settings for visitors.", *(["Notice to mariners"] if i % 24 == 8 else []), "Moorings and pilots", *([text[i], text[i + 1]] if i % 25 else ["Tier Month Rate", f"Fund {name(i)}"])] for i in range(240)]
    site = wrapper_site(pages)
    assert p4_main_body.label_lines("\n".join(pages[25]), site) == "FFMM"  # a heading of tables, on ten pages
    assert p4_main_body.label_lines("\n".join(pages[8]), site) == "FFFMM"  # on ten pages too, but among the lines of the head


def test_p4_side_box_of_any_length():
    links = [f"How the {n} works" for n in ("zeppelin", "kayak", "oboe", "loom", "glacier", "comet", "anvil", "heron", "turbine", "lantern", "meadow", "saddle", "walnut", "harbour")]
    body = prose_body(0)
    got = p4_main_body.label_lines("\n".join([*body[:3], "Related products", *links]), p4_main_body.NO_SITE)
    assert got == "MMM" + "F" * (len(links) + 1)
    got = p4_main_body.label_lines("\n".join(["Related products", *links, *body[:3]]), p4_main_body.NO_SITE)
    assert got == "F" * (len(links) + 1) + "MMM"


def test_p4_side_box_goes_on_behind_rows_and_lists():
    links = [f"How the {n} works" for n in ("zeppelin", "kayak", "oboe", "loom", "glacier", "comet")]
    lines = ["Related products", *links[:3], "Cards | Loans | Savings | Branches | Careers", "May-22 | 84,296 | 16", *links[3:]]
    assert p4_main_body.label_lines("\n".join(lines), p4_main_body.NO_SITE) == "FFFFFMFFF"


def test_p4_menu_labels_from_the_whole_page():
    menu = "Finance > Cards > Careers > Help"
    pages = [["\n" * 50 + menu], [*prose_body(1)[:3], "Careers | Finance | Branches"], *[[*prose_body(i)[:3], menu] for i in range(3)]]
    site = wrapper_site(pages)
    assert p4_main_body.label_lines("\n".join(pages[0]), site) == "B" * 50 + "F" and p4_main_body.label_lines("\n".join(pages[1]), site) == "MMMF"


def test_p4_common_words_count_all_pages(spark, monkeypatch):
    monkeypatch.setattr(p4_main_body, "HELD_WORDS", 50, raising=False)
    words = {i: {f"own{chr(97 + i % 26)}", *(["rare"] if i % 25 < 4 else []), *(["often"] if i % 100 < 17 else [])} for i in range(6000)}
    rows = [(i, " ".join(sorted(w)) + (" long" * 12_000 if i % 6 == 0 else "")) for i, w in words.items()]
    got = p4_main_body.common_words(spark.createDataFrame([*rows, (6000, None)], "page_id bigint, content string"))
    assert got == {"often", "long"}  # 17 % and a sixth of the pages; "rare" is on 16 %, "own" on less


def test_p4_alignment_keeps_every_token():
    n = lambda lo: [p4_main_body.Node(x, 0, 1) for x in range(lo, lo + 300)]
    e = p4_main_body.align(p4_main_body.align(n(0), n(150)), n(300))
    assert sorted(x.key for x in e) == list(range(600)) and sum(x.pages for x in e) == 900


UNSEEN = {  # wordings that stand nowhere in the module
    "filler": ["Turpior magnosus dictorum velitae consectum. Lacinor eratum pellentia mollior faucibor, ornatus sapienor luctum dignorum.",
               "Vivamor ligulae rutrior. Porttitum senecta nullamor feliciter tristis auctorum commodor, bibendor egestor placerum."],
    "notice": ["Sorry! We could not locate the document you asked for. It may have been renamed.",
               "The application server returned an error. Try again later or contact the administrator, error code 5512.",
               "JavaScript appears to be disabled in your browser. Please switch it on and reload the page to continue.",
               "Your session is no longer valid. Please sign in again to continue.",
               "Access to this document is denied: you do not have the permission to view it."],
}


def test_p7_wordings_that_the_module_does_not_hold():
    source = Path(p7_residue.__file__).read_text()
    assert not any(x in source for v in UNSEEN.values() for x in v)
    bodies = [prose_body(i) for i in range(300)]
    prose = p7_residue.line_counts([x for b in bodies for x in b])
    models = p7_residue.learned(p7_residue.seed_counts(), prose, np.zeros((2, p7_residue.SLOTS), np.int64))
    judge = lambda lines: p7_residue.residue([(x, p4_main_body.plain(x)) for x in lines], models)[0]
    assert all(judge([*prose_body(1)[:3], x]) and judge([x]) for x in UNSEEN["filler"])
    assert all(judge([x]) and not judge([*prose_body(1), *prose_body(2), x]) for x in UNSEEN["notice"])
    assert not any(judge(b) for b in bodies[:20])


def test_p7_learns_wordings_beside_known_ones():
    bodies = [prose_body(i) for i in range(300)] + [["Page not found. It may have been moved.", "Pray consult the harbour master."]] * 6
    texts = [[p4_main_body.plain(x) for x in b] for b in bodies]
    prose, none = p7_residue.line_counts([x for b in texts for x in b]), np.zeros((2, p7_residue.SLOTS), np.int64)
    models = p7_residue.learned(p7_residue.seed_counts(), prose, none)
    near = [(int(p7_residue.line_grams(b)[1].sum()), some) for b in texts if (some := p7_residue.near_lines(b, models))]
    more = p7_residue.moved(near, models)
    assert more[1].sum() > 0 and more[0].sum() == 0
    assert all(p7_residue.residue([(x, x) for x in b], p7_residue.learned(p7_residue.seed_counts(), prose, more))[0] == (b[0].startswith("Page not")) for b in texts[290:])


def test_p7_sentences_about_templates():
    assert not p7_residue.placeholders("A developer writes {name} where the template needs a customer.")
    assert not p7_residue.placeholders("The token &lt;NAME&gt; stands for the reader and is filled in later.")
    assert p7_residue.placeholders("Dear &lt;first_name&gt;, the draft is ready.") and p7_residue.placeholders("The field unit met {$city} today.")


def test_p7_residue(site):
    df, _ = site
    assert {r.page_id for r in p7_residue.found(df).collect()} == {100, 101, 102, 103}
    r = {x.page_id: x for x in p7_residue.report(df).collect()}
    assert r[103].holes == 1 and r[104].holes == 0 and r[903].body == 0
    assert not p7_residue.placeholders("plain text") and p7_residue.placeholders("[CITY TO BE ADDED]")


def test_p6_types(site):
    df, _ = site
    got = {r.page_id: r for r in p6_text_types.types(df).collect()}
    assert {r.page_id for r in p6_text_types.found(df).collect()} == {105, 106, 107, 904}  # 904 is one word over and over
    assert got[0].type == "prose" and got[108].type == "prose" and got[903].type == "empty" and got[903].word_length is None


@pytest.mark.parametrize("run", [p1_site_lines.found, p1_site_lines.clean, p4_main_body.found, p4_main_body.wrappers, p5_repetition.found, p6_text_types.found, p6_text_types.types, p7_residue.found])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_single_hot_site(spark):
    df = frame(spark, [page(i, "http://hot.org/", f"same line\nown {'x' * (i + 1)}") for i in range(400)])
    assert p1_site_lines.found(df).filter(F.col("line_no") == 0).count() == 400
