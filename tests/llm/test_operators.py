"""The operators on small tables: against brute force, and on the cases that their docstrings define."""

import collections
import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import byte_cnn, bytehash, chat_format, co_training, decontaminate, html_extract, lattice_dedup, mixing, ngram_jaccard, pii, sharding

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(400)]


def docs_of(spark, rows):
    """rows of (doc_id, text) with other columns, one of which clashes with names used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, token string, n int")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- n-gram Jaccard -----------------------------------------------------------------------------------------------
def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups=12, size=9):
    rng = random.Random(seed)
    rows, passage = [], rng.choices(WORDS, k=60)
    for _ in range(groups):
        base = rng.choices(WORDS, k=rng.randint(3, 120))
        if rng.random() < 0.5:
            base += passage
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choices(WORDS, k=rng.choice([0, 1, 2]))
            rows.append((" " if rng.random() < 0.5 else "\n").join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few", [64, 0.01])  # with and without rounds of hubs
def test_jaccard_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_jaccard, "FEW", few)
    rows = near_copies(1) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "One TWO"), (1005, "é É"), (1006, "é é"), (1007, "w1 " * 5000),
        (1008, "w1 " * 6000)]
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)  # tiles of several blocks
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(spark, docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd_rows(spark):
    got = ngram_jaccard.jaccard_components(spark, docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "x")]))
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == {(1, 1): 2, (None, None): 1, (3, 3): 1}
    assert ngram_jaccard.jaccard_components(spark, docs_of(spark, [])).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    one, two = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    rows = [(1, one), (5, one), (5, two), (6, two + " more"), (None, two), (8, two), (9, ""), (9, ""), (4, "x"), (4, "x")]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(spark, docs_of(spark, rows)).collect())
    assert got == collections.Counter([(1, 56, 1), (5, 56, 1), (5, 56, 5), (6, 57, 5), (None, 56, None), (8, 56, 5), (9, 0, 9), (9, 0, 9), (4, 1, 4), (4, 1, 4)])
    docs = docs_of(spark, rows)
    kept = ngram_jaccard.distinct_documents(spark, docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(1, one), (5, two), (9, ""), (9, ""), (4, "x")])


def test_a_row_without_id_links_others(spark):
    rows = [(7, " ".join(WORDS[:100])), (None, " ".join(WORDS[8:108])), (3, " ".join(WORDS[16:116]))]
    sets = [shingles(t) for _, t in rows]
    assert len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8 <= min(len(sets[k] & sets[1]) / len(sets[k] | sets[1]) for k in (0, 2))
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(spark, docs_of(spark, rows)).collect()}
    assert got == {7: 3, 3: 3, None: None}


def test_words_are_hashed_alike_in_pieces_of_any_size(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abé \t\n", k=rng.choice([0, 3, 50, 2000]))) for _ in range(60)] + ["x" * 9000 + " y"]
    column = pa.array([*texts, None])
    want = [s.tolist() for s in bytehash.shingle_sets(column)]
    assert [len(s) for s in want] == [len(shingles(t)) for t in texts] + [0]
    monkeypatch.setattr(bytehash, "PIECE", 64)
    monkeypatch.setattr(bytehash, "_POWERS", [])
    assert [s.tolist() for s in bytehash.shingle_sets(column)] == want


# --- decontamination ----------------------------------------------------------------------------------------------
def brute_hits(text, items):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    hit, found = set(), set()
    for item, t in items:
        x = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        wins = [x[k : k + 10] for k in range(len(x) - 9)] if len(x) >= 10 else [x] if x else []
        for win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def decontamination_case(seed=3):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(WORDS[:60], k=rng.choice([3, 9, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, "!?"), (52, "É-Ab,c")]
    rows = []
    for k in range(60):
        w = rng.choices(WORDS[:60], k=rng.randint(0, 40))
        if k % 3:
            t = rng.choice(items[:12])[1].split()
            a = rng.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[a // 2 : max(a, len(t) - a // 2)] if k % 2 else t
        rows.append((k, "  ".join(x.upper() if rng.random() < 0.2 else x for x in w) + rng.choice(["", ".", "\n"])))
    return rows + [(100, None), (101, ""), (102, "x É ab c y"), (103, "x é ab c y")], items


def test_decontamination_equals_brute_force(spark, tmp_path):
    rows, items = decontamination_case()
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.query(spark, str(tmp_path)).collect()}
    want = {i: brute_hits(t, items) for i, t in rows}
    assert got == want
    assert any(v[1] for v in want.values())
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontaminate.decontaminate(spark, docs_of(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[1]}
    assert kept.columns == docs_of(spark, []).columns
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(spark, docs_of(spark, rows), bench, "spans").collect()}
    texts = dict(rows)
    for i, v in want.items():
        assert cleaned[i] == texts[i] if not v[1] else brute_hits(cleaned[i], [])[0] == v[0] - v[1]


def test_decontamination_of_capital_sigmas(spark, tmp_path):
    greek = "ΟΔΟΣ ΛΟΓΟΣ ΝΟΜΟΣ ΤΟΠΟΣ ΒΙΟΣ ΦΩΣ ΔΗΜΟΣ ΚΟΣΜΟΣ ΧΡΟΝΟΣ ΑΝΘΡΩΠΟΣ"
    rows = [(1, greek.replace(" ", ".") + ".A"), (2, greek.replace(" ", "'") + "'x"), (3, greek), (4, greek.lower())]
    items = [(0, greek), (1, "Kelvin \u212a one two three four five six seven eight nine")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.query(spark, str(tmp_path)).collect()}
    assert got == {i: brute_hits(t, items) for i, t in rows} and [got[k][1] for k in (1, 2, 3, 4)] == [10, 10, 10, 0]


def test_decontamination_empty_and_repeated(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    got = decontaminate.contamination(spark, docs, none).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"] and all(not r["spans"] for r in got)
    assert decontaminate.contamination(spark, docs_of(spark, []), none).count() == 0


# --- personal data ------------------------------------------------------------------------------------------------
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            if k == 0 or k == 1 and all(int(x) <= 255
                for x in m[0].split(".")) or k == 2 and 13 <= len(digits) <= 19 and total % 10 == 0 or k == 3 and 9 <= len(digits) <= 15:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    pieces = ["a@b.c", "x", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0143", "+", "1", " ", "-", "é", "..", "d.e",
        "\n", "٣"]
    for _ in range(3000):
        t = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_base_spans_need_no_more_than_linear_time():
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000 + ".") == []


def test_bootstrapping_finds_what_patterns_miss(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"text number reach me at {rng.randint(10**5, 10**6)}.user{k}@mail.example.com please") for k in range(40)]
    rows += [(100, "text number reach me at 55512345x please"), (101, "paid invoice no 55599999x today"), (102, None), (103, ""), (103, "")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[100] == "email:24:33" and spans[101] == "" and spans[102] == ""
    one = next(r for r in got if r["doc_id"] == 0)
    a, b = rows[0][1].index("me at ") + 6, rows[0][1].index(" please")
    assert (one["n_email"], one["base_sha256"]) == (1, hashlib.sha256(f"email:{a}:{b}".encode()).hexdigest())
    both = [(1, "x"), (None, rows[2][1])]
    masked = collections.Counter((r["doc_id"], r["text"]) for r in pii.redact(spark, docs_of(spark, rows[:3] + both)).collect())
    mark = "text number reach me at [EMAIL] please"
    assert masked == collections.Counter([(0, mark), (1, mark), (2, mark), (1, "x"), (None, mark)])
    assert pii.personal_data(spark, docs_of(spark, [])).count() == 0


def test_counts_of_each_kind_equal_plain_patterns(spark, tmp_path):
    rng = random.Random(8)
    pieces = ["a@b.c", "x", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0143", "é\U0001f600", "\n", ""]
    rows = [(k, " x ".join(rng.choices(pieces, k=rng.randint(0, 12)))) for k in range(300)] + [(900, None), (901, ""), (902, "host 1.2.3.4 up")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.query(spark, str(tmp_path)).collect()}
    for i, t in rows:
        spans = brute_spans(t or "")
        line = ",".join(f"{pii.BASE[k]}:{a}:{z}" for k, a, z in spans)
        assert got[i] == (*[sum(k == x for k, _, _ in spans) for x in range(4)], hashlib.sha256(line.encode()).hexdigest()), t
    assert got[902][:4] == (0, 1, 0, 0)


def brute_discovered(texts):
    """The rounds of the docstring in plain Python: (document, kind, start, end) of all added spans."""
    cells = [(i, c) for i, t in texts.items() for c in pii.slots(t, pii.base_spans(t))]
    edges, known = collections.defaultdict(set), {}
    for _, c in cells:
        for p in c["patterns"]:
            edges[p].add(c["value"])
    seeds = [(c["value"], c["kind"]) for _, c in cells if c["kind"] is not None and c["patterns"]]
    for v, k in seeds:
        known[v] = min(k, known.get(v, 9))
    added = {}
    for _ in range(pii.ROUNDS):
        best = collections.defaultdict(lambda: collections.defaultdict(lambda: 1.0))
        for values in edges.values():
            kinds = collections.Counter(known[v] for v in values if v in known)
            u = sum(v not in known for v in values)
            for k, n in kinds.items():
                conf = n / (sum(kinds.values()) + pii.UNKNOWN * u)
                if n >= pii.MIN_KNOWN and conf >= pii.MIN_CONFIDENCE:
                    for v in values:
                        if v not in known:
                            best[v][k] *= max(1 - conf, 1e-9)
        new = {v: max((round(1 - x, 9), -k) for k, x in ks.items()) for v, ks in best.items()}
        new = {v: -k for v, (x, k) in new.items() if x >= pii.MIN_CONFIDENCE}
        if not new:
            break
        added |= new
        known |= new
    out = {(i, c["kind"], c["start"], c["end"]) for i, c in cells if c["kind"] == len(pii.BASE)}
    return out | {(i, added[c["value"]], c["start"], c["end"]) for i, c in cells if c["kind"] is None and c["value"] in added}


def test_rounds_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    token = lambda n=40: "".join(rng.choices("0123456789abcdef", k=n))
    frames = [lambda: f'the token = "{token()}" of', lambda: f"ring me on +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} today",
        lambda: f"write to u{rng.randint(0, 10**6)}@mail.org now", lambda: f"host {rng.randint(0, 255)}.1.2.{rng.randint(0, 255)} up"]
    odd = ['the token = "hunter-two" of', 'the token = "swordfish" of', "ring me on 5550123456 today", "ring me on 555-01-99999 please", "call him on 555-01-99999 soon",
        "write to nobody now", "paid 1234567 in", 'TOKEN: "other" x', "the year 2020-03-11/news_story_of_the_day"]
    odd += [f"call him on +1 ({k}11) 555-0000 soon" for k in range(1, 6)] + ["call him on 777777777 soon"]
    texts = {k: " ".join(rng.choices(WORDS, k=5)) + " " + rng.choice(frames)() + " " + " ".join(rng.choices(WORDS, k=3)) for k in range(200)}
    texts |= {1000 + k: t for k, t in enumerate(odd * 2)}
    got = pii.personal_data(spark, docs_of(spark, list(texts.items()))).collect()
    found = {(r["doc_id"], x["kind"], x["start"], x["end"]) for r in got for x in r["added"]}
    assert found == brute_discovered(texts)
    names = collections.Counter((pii.KINDS[k], texts[i][a:z]) for i, k, a, z in found)
    assert names["secret", "hunter-two"] == names["secret", "swordfish"] == 2 and names["phone", "5550123456"] == 2
    assert not any(x in ("1234567", "2020-03-11/news_story_of_the_day") for _, x in names)
    assert sum(n for (k, _), n in names.items() if k == "secret") >= 40


# --- pages --------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
%s<aside>Side text of some length that is here.</aside><div id="comments"><p>A reader says a lot of things in this comment.</p></div>
<form><p>Subscribe now</p></form><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize("article,text", [
    ("<article><h1>T &amp; t</h1><p>One  two<br>three</p><p>Four&nbsp;five</p><div class=ad>Buy</div></article>", "T & t\nOne two three\nFour five"),
    ("<div id=content><div class='post'><p>A first long paragraph of the text, with words.</p><p>A second long paragraph <a href=x>with link</a> of the text.</p></div></div>", "A first long paragraph of the text, with words.\nA second long paragraph with link of the text."),
    ("<main><p><b>Bold<br><p>Next<ul><li>x<li>y</ul><table><tr><td>1<td>2</table></main>", "Bold\nNext\nx\ny\n1 2"),
    ("<div class='layout has-sidebar'><div class='site-header'><p>The name of this site</p></div><div class='content'><h1>Head</h1><p>A long first paragraph of text, it is.</p><p>A long second paragraph of text, it is.</p></div></div>", "Head\nA long first paragraph of text, it is.\nA long second paragraph of text, it is."),
    ("<ARTICLE><P TITLE='a>b'>Up</P><!-- <p>no</p> --><svg><text>no</text></svg></ARTICLE>", "Up"),
])
def test_main_text(article, text):
    assert html_extract.main_text(PAGE % article) == text


def test_main_text_is_chosen_by_density_inside_marks():
    part = "<p>A long %s paragraph of the text, with a number of words.</p>"
    two = PAGE % f"<article>{part % 'first'}{part % 'second'}</article><article>{part % 'third'}{part % 'fourth'}</article>"
    assert html_extract.main_text(two).split("\n") == [f"A long {k} paragraph of the text, with a number of words." for k in ("first", "second", "third", "fourth")]
    links = "<div class='more'><ul>" + "<li><a href='x'>Go on</a></li>" * 20 + "</ul></div>"
    around = PAGE % f"<main><h1>T</h1>By me<div class='content'>{part % 'first'}{part % 'second'}</div>{links}</main>"
    assert html_extract.main_text(around) == "T\nBy me\n" + "\n".join(f"A long {k} paragraph of the text, with a number of words." for k in ("first", "second"))
    assert html_extract.main_text(PAGE % f"<main></main><div>{part % 'only'}</div>") == "A long only paragraph of the text, with a number of words."


def paragraph(k, tag="p"):
    return f"<{tag}>A long paragraph number {k} of the text, with a good number of words.</{tag}>"


@pytest.mark.parametrize("body,want", [
    ("<div>" + "".join(paragraph(k) for k in range(12)) + "</div>" + paragraph("X", "div") + paragraph("Y", "div"), [*range(12), "X", "Y"]),
    ("".join(paragraph(k, "div") for k in "abc") + "<div>" + "".join(paragraph(k) for k in range(8)) + "</div>" + "".join(paragraph(k, "div") for k in "def"),
        [*"abc", *range(8), *"def"]),
    ("<article>" + paragraph(1) + "<section id='discussion'>" + paragraph(2) + "</section><section class='related work'>" + paragraph(3) + "</section></article>",
        [1, 2, 3]),
    ("<main><article>" + paragraph(1) + paragraph(2) + "</article><section id='discussion'>" + paragraph(3) + "</section></main>", [1, 2]),
    ("<div id='wrap'><div>" + paragraph(1) + paragraph(2) + "</div><div><ul>" + "<li><a href='x'>Go to that page</a></li>" * 9 + "</ul></div></div>", [1, 2]),
])
def test_siblings_go_by_density_and_keep_their_order(body, want):
    assert re.findall(r"number (\w+) of", html_extract.main_text(f"<html><body>{body}</body></html>")) == [str(k) for k in want]


def test_short_flow_text_around_the_core_stays():
    page = "<body><nav><a href=x>y</a></nav><div><h1>Head</h1><p>Short.</p>%s<p>See <a href=x>it</a>.</p>Bare <b>bold</b> end</div><footer>f</footer></body>"
    assert html_extract.main_text(page % paragraph(1)) == "Head\nShort.\nA long paragraph number 1 of the text, with a good number of words.\nSee it.\nBare bold end"


def test_pages_without_marks_give_the_same_text(spark):
    """The article of each page in a plain element: density alone finds it."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert plain != r["html"] and html_extract.main_text(plain) == html_extract.main_text(r["html"])


@pytest.mark.parametrize("inside,text", [
    ("<p>See the <a href='/wiki/Hidden_Markov_model'>model</a> here</p>", "See the model here"),
    ("<p>See the <a href=/p?id=share title='The hidden one'>page</a> here</p>", "See the page here"),
    ("<p data-hidden='false' data-overflow=hidden data-class=ad>Words</p>", "Words"),
    ("<p hidden>No</p><p HIDDEN=''>No</p><p Class = 'ad'>No</p><p style='color:red;display: none'>No</p><p>Yes</p>", "Yes"),
    ("<p>One <svg class='i' /> two</p><p><svg/>three <!-->four</p>", "One two\nthree four"),
    ("<p>One <svg data-x='>'><text>no</text></svg> two</p><script src=/a/>no</script><title-bar>three</title-bar>", "One two\nthree"),
])
def test_attributes_are_whole_names(inside, text):
    assert html_extract.main_text(PAGE % f"<article>{inside}</article>") == text


def test_pages_of_the_tables(spark):
    for r in html_extract.query(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        x = r["html"]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
            for b in re.split("</?p>|</?h1>", x[x.index("<article>") + 9 : x.index("</article>")])]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_extraction_of_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>a"), (2, "u", "<p>a"), (3, "u", "<p>" + "a b" * 400_000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = collections.Counter((r["page_id"], r["url"], r["n_chars"]) for r in html_extract.extract(frame).collect())
    assert got == collections.Counter([(1, None, 0), (None, "u", 0), (2, "u", 1), (2, "u", 1), (3, "u", 1_200_000)])
    assert html_extract.extract(frame.where("false")).count() == 0


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</p></div>", "<body>", "<script>x", "<!-- x", "<a href='x>y", "<div>" * 3000 + "deep", "plain & text"])
def test_odd_pages(page):
    assert html_extract.main_text(page) == {"<div>" * 3000 + "deep": "deep", "plain & text": "plain & text", "<": "<", "<p": "<p", "<a href='x>y": "y"}.get(page, "")


# --- embeddings ---------------------------------------------------------------------------------------------------
def vectors(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    x = base[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.05, 0.15, 0.3], n)[:, None]
    return x.astype(np.float32), rng.integers(0, 3, n)


def brute_links(x, label):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= lattice_dedup.THRESHOLD) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(link, low[None, :], len(x)).min(1))
        if (new == low).all():
            return link.sum(1), low
        low = new


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 2
    p = lattice_dedup.nearest_e8(x)
    assert ((p * 2) % 1 == 0).all() and (p.sum(1) % 2 == 0).all()
    far = ((x - p) ** 2).sum(1)
    assert (far[:, None] <= ((x[:, None] - (p[:, None] + lattice_dedup._ROOTS[None])) ** 2).sum(2) + 1e-9).all()
    assert len(lattice_dedup._ROOTS) == 240


@pytest.mark.parametrize("block", [2000, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    x, label = vectors()
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice_dedup.near_duplicates(spark, frame).collect()}
    n, low = brute_links(x, label)
    found = sum(v[0] for v in got.values())
    assert 0.98 * n.sum() <= found <= n.sum() and n.sum() > 1000
    assert sum(got[i] == (n[i], low[i], low[i] == i) for i in got) >= 0.95 * len(got)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (11, [], 1), (12, [float("inf"), 1.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice_dedup.near_duplicates(spark, frame).collect())
    want = collections.Counter([(1, 1, 1, True), (2, 1, 1, False), (9, 1, 9, True), (9, 1, 9, True),
        (None, 0, None, False)] + [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 11, 12)])
    assert got == want
    assert lattice_dedup.near_duplicates(spark, frame.where("false")).count() == 0


# --- languages ----------------------------------------------------------------------------------------------------
def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = byte_cnn.identify(docs, byte_cnn.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_scores_are_those_of_the_plain_network(spark):
    """Tables of byte pairs against the convolutions as they are defined, over whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = byte_cnn.train(docs)
    w, reach = byte_cnn.WINDOW, max(byte_cnn.WIDTHS)
    for r in byte_cnn.identify(docs, net).join(docs.select("doc_id", "text"), "doc_id").collect()[:40]:
        raw = (r["text"] or "").encode()
        total, weight = np.zeros(len(net.langs)), 0
        for a in range(0, len(raw), w):
            part = np.frombuffer(raw[a : a + w], np.uint8)
            x = np.concatenate([part, np.zeros(w + reach - 1 - len(part), np.uint8)])
            top = [max(sum(net.p[f"f{n}"][k, x[i + k], f] for k in range(n)) for i in range(w)) for n in byte_cnn.WIDTHS for f in range(byte_cnn.FILTERS)]
            z = np.maximum(np.array(top) + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"]
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(part)
            weight += len(part)
            if a > 600:
                break
        else:
            if any(c.isalpha() for c in r["text"] or ""):
                assert r["lang_pred"] == net.langs[int(total.argmax())] and abs(r["score"] - total.max() / weight) < 1e-4


def test_language_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = byte_cnn.train(docs)
    text = docs.where("lang = 'en' and n_chars between 1000 and 3000").orderBy("doc_id").first()["text"]
    rows = docs_of(spark, [(1, None), (2, ""), (3, "123 !!"), (4, text * 100), (None, text), (4, text * 100)])
    got = byte_cnn.identify(rows, net).collect()
    assert len(got) == 6 and [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert {r["lang_pred"] for r in got if r["doc_id"] == 4} == {"en"}
    assert {r["lang_pred"] for r in byte_cnn.identify(rows, byte_cnn.train(docs_of(spark, []))).collect()} == {"und"}
    kept = byte_cnn.recognised(rows, net)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {4, None}


def test_language_is_learnt_from_other_documents_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit("zz")).otherwise(F.col("lang")))
    assert byte_cnn.train(wrong).langs == byte_cnn.train(docs).langs
    assert all((a == b).all() for a, b in zip(byte_cnn.train(wrong).tables(), byte_cnn.train(docs).tables()))


# --- quality ------------------------------------------------------------------------------------------------------
def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = co_training.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = np.array([r["quality"] == 1 for r in got])
    s = np.array([r["score"] for r in got])
    assert np.mean((s > 0.5) == good) >= 0.95 and s[good].mean() > s[~good].mean() + 0.5


def test_quality_of_documents_whose_labels_are_kept_away(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    away = F.expr("crc32(cast(doc_id as string)) % 4 = 1")
    model = co_training.train(docs, labels.where(~away))
    got = co_training.score(docs, model).join(labels.where(away), "doc_id").collect()
    right = [(r["score"] > 0.5) == (r["quality"] == 1) for r in got]
    assert len(got) > 50 and np.mean(right) >= 0.9


def test_quality_with_repeated_ids(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = co_training.train(docs.unionByName(docs.where("doc_id % 2 = 0")), labels.unionByName(labels.withColumn("quality", F.lit(1))))
    assert co_training.score(docs.unionByName(docs.limit(3)), model).count() == docs.count() + 3
    assert co_training.score(docs.where("false"), model).count() == 0


def test_quality_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = co_training.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "", "x", "y", -5), (2, "a " * 100_000, "s", "en", 10**15), (2, "a", "s", "en", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    assert all(0 <= r["score"] <= 1 for r in co_training.score(rows, model).collect())
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert co_training.train(docs, none) is None
    assert [r["score"] for r in co_training.score(rows, None).collect()] == [0.5] * 4


def test_quality_pool_is_every_other_document(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(co_training, "SAMPLE", 200)
    seen = []

    def co_train(xt, xm, y, pool, scratch, run=co_training.co_train):
        views, tie = {"text": None, "meta": None}, np.array([r["tie"] for r in pool.collect()])
        for k, dim in (("text", co_training.TEXT_DIM), ("meta", co_training.META_DIM)):
            views[k] = np.stack([np.frombuffer(r[k], np.float32) for r in pool.collect()]).reshape(-1, dim)
        rounds, handed = [], co_training._newly_handed
        monkeypatch.setattr(co_training, "_newly_handed", lambda r: (rounds.append(r), handed(r))[1])
        model = run(xt, xm, y, pool, scratch)
        seen.append((len(y), len(tie), y, xt, xm, views, tie, rounds, model))
        return model

    monkeypatch.setattr(co_training, "co_train", co_train)
    co_training.train(docs, labels)
    [(n, size, y, xt, xm, views, tie, rounds, model)] = seen
    assert n <= 400 and n + size == docs.count()
    assert len(rounds) == co_training.ROUNDS
    fitted = np.arange(n) % 4 != 3
    take, good = max(1, int(co_training.SHARE * size)), y[fitted].mean()
    n_good = max(1, round(take * good))
    given = {k: {} for k in views}  # brute force: the most confident of those not yet handed over
    for bounds in rounds[-1]:
        for k, other in co_training.OTHER.items():
            key = co_training.keys(bounds[k][0], views[k], tie)
            order = [i for i in np.argsort(key, kind="stable") if i not in given[other]]
            given[other] |= {i: 1 for i in order[-n_good:]} | {i: 0 for i in order[: take - n_good]}
    for k, own in (("text", xt), ("meta", xm)):
        got = co_training.handed(rounds[-1], views, tie)[k]
        assert {i: got[i] for i in np.flatnonzero(~np.isnan(got))} == given[k]
        at = sorted(given[k])
        whole = co_training.Logistic(3.0)
        whole.fit(np.concatenate([own[fitted], views[k][at]]), np.concatenate([y[fitted], [given[k][i] for i in at]]))
        assert np.abs(whole.w - getattr(model, k).w).max() < 1e-4


# --- sharding -----------------------------------------------------------------------------------------------------
def test_lookup_table():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 211)
    taken, orders = {}, []  # brute force: turns in which each shard takes the first free place of its whole order
    for n in names:
        start, step = sharding._hash("start", n) % 211, sharding._hash("step", n) % 210 + 1
        orders.append([(start + k * step) % 211 for k in range(211)])
        assert sorted(orders[-1]) == list(range(211))
    while len(taken) < 211:
        for k in range(7):
            if len(taken) < 211:
                taken[next(x for x in orders[k] if x not in taken)] = k
    assert table == [taken[x] for x in range(211)]
    sizes = collections.Counter(table)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved <= 0.25 * 211
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(wrong)


def test_placement(spark, tmp_path):
    docs = docs_of(spark, [(k, "t") for k in range(500)] + [(None, None), (7, "t")]).withColumns({"Slot": F.lit("clash"), "__shard": F.lit("kept")})
    got = sharding.place(spark, docs).collect()
    table = sharding.lookup_table(sharding.shard_names())
    for r in got:
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"], r["__shard"]) == (slot, table[slot], "kept")
    assert len(got) == 502
    sharding.write_shards(sharding.place(spark, docs), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 502


def test_sharding_query_returns_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.query(spark, SF)
    assert got.columns == [*docs.columns, "slot", "shard"]
    assert sorted(got.drop("slot", "shard").collect()) == sorted(docs.collect())


# --- chats --------------------------------------------------------------------------------------------------------
def test_chat_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"),
        (3, 1, "assistant", "b"), (3, 2, "user", "c"),
            (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, None, None, None), (6, 0, "user", None), (7, 0, "user", ""), (None, 0, "user", "z")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat_format.render(spark, frame).collect()}
    assert set(got) == {2, 4, 5, 6, 7, None}
    assert got[None] == (1, "<|im_start|>user\nz<|im_end|>\n")
    assert got[4] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n") and got[5] == (1, "<|im_start|>unknown\n<|im_end|>\n")
    assert chat_format.render(spark, frame.where("false")).count() == 0


def test_rows_without_conversation_and_long_conversations(spark, monkeypatch):
    rows = [(None, k % 3, "user", "abcd"[k % 4]) for k in range(24)] + [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "d")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((str(r["conv_id"]), r["n_turns"], r["part"], r["text"].count("im_start"), r["text"].split("\n")[1][0])
        for r in chat_format.render(spark, frame).collect())
    # a is a prefix of 1, d equals 2; each of b and c stays once, whatever its turn
    assert got == [("1", 2, 0, 2, "a"), ("2", 1, 0, 1, "d"), ("None", 1, 0, 1, "b"), ("None", 1, 0, 1, "c")]
    monkeypatch.setattr(chat_format, "PART", 100)
    long = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(250)] + [(2, k, "user", f"t{k}") for k in range(180)], frame.schema)
    got = sorted((r["conv_id"], r["n_turns"], r["part"], r["text"]) for r in chat_format.render(spark, long).collect())
    assert [x[:3] for x in got] == [(1, 250, 0), (1, 250, 1), (1, 250, 2)]
    assert "".join(x[3] for x in got) == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(250))


# --- mixing -------------------------------------------------------------------------------------------------------
def test_mixing_reaches_the_weights(spark):
    rows = [(k, "t", "en", "abc"[min(k % 10, 2)], 1) for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("gone", 1.0)], "source string, weight double")
    got = {r["source"]: r["n"] for r in mixing.mix(spark, docs, weights, 30_000).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {"a", "b"} and all(abs(n - 15_000) < 600 for n in got.values())
    high = mixing.mix(spark, docs.where("doc_id < 30"), spark.createDataFrame([("a", 1.0)], "source string, weight double"), 300).groupBy("doc_id").count().collect()
    assert len(high) == 3 and 200 < sum(r["count"] for r in high) < 400  # a rate of 100


def test_mixing_odd_rows(spark):
    docs = docs_of(spark, [(1, "a"), (1, "a"), (None, None)]).withColumn("source",
        F.lit(None).cast("string")).withColumns({"rate": F.lit("x"), "__n": F.lit("kept"), "__u": F.lit("kept"), "Copy": F.lit("gone")})
    got = mixing.mix(spark, docs)
    assert got.columns == [*[c for c in docs.columns if c != "Copy"], "copy", "shuffle_key"]
    assert {(r["__n"], r["__u"]) for r in got.collect()} <= {("kept", "kept")}
    again = mixing.mix(spark, docs)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    counts = collections.Counter(r["doc_id"] for r in got.collect())
    assert counts[1] % 2 == 0
    assert mixing.mix(spark, docs_of(spark, [])).count() == 0
