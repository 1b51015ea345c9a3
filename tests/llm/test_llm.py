"""Training-data operators against brute force, exact round trips and edge cases."""

import random
import re
import time
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsearch.llm import boilerplate, entities, golay, lookalike, mixing, names, neardup, sitelines, tokens

SF = "/root/testdata/sf0.001"
WEB = "doc_id string, domain string, title string, body string, headings array<string>, chunks array<string>"


# Tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "0", " ", "\n", "'s", ".", "日本", "é", "'", "xyz Q", "\u200b"]), st.integers(1, 90)), max_size=8))
def test_tree_is_exact(parts):
    s = "".join(x * n for x, n in parts)
    nodes = [dict(hard=h, **dict(zip(("ids", "head", "tail"), tokens.encode_leaf(x)))) for h, x in tokens.leaves(s, 80)]
    while len(nodes) > 1:
        nodes = [tokens.join_nodes(*nodes[i : i + 2]) if len(nodes[i : i + 2]) == 2 else nodes[i] for i in range(0, len(nodes), 2)]
    assert nodes[0]["ids"] == tokens.encoder().encode_ordinary(s)


def test_encode_corpus(spark):
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (4, "z" * 5000 + " tail"), (4, "z" * 5000 + " tail"), (5, "  \n " * 700), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("row", F.lit(0))
    got = tokens.encode_corpus(df, leaf=256)
    assert got.columns == ["doc_id", "ids"]
    enc = tokens.encoder()
    want = sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r[0]), list(r[1])) for r in got.collect()) == want
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# Repeated lines


def test_cuts_depend_on_the_window():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    whole, part = sitelines.cuts(data), sitelines.cuts(data[1000:3000]) + 1000
    assert [c for c in whole if 1000 + sitelines.WINDOW <= c <= 3000] == part.tolist()


def test_repeated_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    stock = ["Home", "Read 5 more", " ".join(word() for _ in range(40)), "x"]
    rows = [(f"d{n}", "s" if n < 30 else "t", "\r\n".join([*(s.upper() if n % 3 else s.replace("5", str(n)) for s in rng.sample(stock, 3)), " ".join(word() for _ in range(12)), "  "])) for n in range(40)]
    rows += [("e1", None, "Home"), ("e2", "s", None), ("e3", "s", ""), (None, "s", "Home"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id string, domain string, body string").withColumn("id", F.lit(1)).withColumn("line", F.lit("c"))
    seen, lines = {}, []
    for i, m, b in rows:
        if i and m and b:
            for n, x in enumerate(b.split("\n"), 1):
                x = re.sub(r"\d+", "0", " ".join(x.lower().split()))
                if x:
                    seen.setdefault((m, x), set()).add(i)
                    lines.append((i, n, m, x))
    want = {(i, n) for i, n, m, x in lines if len(seen[m, x]) >= 8}
    assert {tuple(r) for r in sitelines.repeated_lines(df).collect()} == want and want
    clean = {r["doc_id"]: r["text"] for r in sitelines.without_repeated(df).collect()}
    assert clean["e2"] is None and "home" not in clean["d1"].lower().split("\n")
    assert sitelines.repeated_lines(df.limit(0)).count() == 0


# Near duplicates


def test_golay_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    near = golay.near_codewords(words)
    check, _ = golay._tables()
    code = lambda i: (i << 11) | int(check[i])
    for w, row in zip(words.tolist(), near.tolist()):
        d = [(w ^ code(i)).bit_count() for i in row]
        assert d[0] <= 3 and all(x <= 4 for x in d) and (d[0] < 3 or len(set(row)) == 6)
    assert (golay.nearest_codeword(words) == near[:, 0]).all()
    assert min(code(i).bit_count() for i in range(1, 4096)) == 7


def sets(rows):
    out = {}
    for i, t, b in rows:
        w = re.findall(r"[^\W_]+", f"{t or ''} {b}".lower()) if b else []
        out[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {i: s for i, s in out.items() if s}


def brute(rows, least):
    s = sets(rows)
    return {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) >= least * len(s[a] | s[b])}


def test_similar_pairs(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for n in range(25):
        base = [rng.choice(vocab) for _ in range(160)]
        rows.append((f"p{n}", f"Title {n}", " ".join(base)))
        for k in range(3):
            w = list(base)
            for _ in range(4 * k):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((f"p{n}-{k}", f"Title {n}", " ".join(w[40:] + w[:40] if k == 2 else w)))
    rows += [("n1", None, None), ("n2", None, ""), ("n3", None, "two words"), (None, "t", "a b c d"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id string, title string, body string").withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    want = brute([r for r in rows if r[0]], 0.5)
    got = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    assert not got - want and len(got & want) >= 0.97 * len(want)
    groups = neardup.similar_groups(df).collect()
    assert len({r["group_id"] for r in groups}) == 25 and {r["doc_id"] for r in groups} == set(sets([r for r in rows if r[0]]))
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_groups_hold_the_pairs(spark):
    base = [f"word{n}" for n in range(200)]
    rows = [("a", "t", " ".join(base)), ("b", "t", " ".join([*base[:150], *(f"other{n}" for n in range(50))])), ("c", "t", " ".join(f"far{n}" for n in range(200)))]
    assert brute(rows, 0.5) == {("a", "b")} and brute(rows, 0.8) == set()
    df = spark.createDataFrame(rows, "doc_id string, title string, body string")
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == {("a", "b")}
    assert {tuple(r) for r in neardup.similar_groups(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_near_codewords_find_the_pairs(spark):
    # Every twelfth word changed: no window of 44 words is left as it was.
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    rows = []
    for n in range(40):
        base = [rng.choice(vocab) for _ in range(360)]
        other = [rng.choice(vocab) if k % 12 == 7 else w for k, w in enumerate(base)]
        rows += [(f"a{n}", "", " ".join(base)), (f"b{n}", "", " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id string, title string, body string")
    want = brute(rows, 0.5)
    assert len(want) == 40
    found = {near: {tuple(r) for r in neardup.similar_pairs(df, near=near).collect()} for near in (True, False)}
    assert found[False] < found[True] <= want and len(found[True]) >= 39 and len(found[False]) <= 34


def test_one_word_costs_two_bits():
    rng = np.random.default_rng(8)
    low, met = (1 << neardup.BITS) - 1, 0
    for _ in range(50):
        words = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        other = words.copy()
        other[100] = 12345
        one, two = ({t >> neardup.BITS: (p, t & low) for p, t in zip(*(x.tolist() for x in neardup.windows(w)))} for w in (words, other))
        for first in one.keys() & two.keys():
            (p, t), (q, u) = one[first], two[first]
            assert (p ^ q).bit_count() + (t ^ u).bit_count() <= 2
            met += (p, t) != (q, u)
    assert met >= 50
    golay_words = rng.integers(0, 1 << 23, 2000)
    flips = (1 << rng.integers(0, 23, 2000)) | (1 << rng.integers(0, 23, 2000))
    a, b = golay.near_codewords(golay_words), golay.near_codewords(golay_words ^ flips)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))


def test_groups_are_the_components_of_the_pairs(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    rows = []
    for n in range(6):
        base = [rng.choice(vocab) for _ in range(240)]
        for k in range(12):  # a chain: each is like the next, the ends are not alike
            base = base[20:] + [rng.choice(vocab) for _ in range(20)]
            rows.append((f"{n}-{k:02d}", "", " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id string, title string, body string")
    assert {tuple(r) for r in neardup.similar_groups(df).collect()} == {(i, f"{i[0]}-00") for i, _, _ in rows}


def test_copies_of_one_page(spark):
    df = spark.range(300).select(F.format_string("c%04d", "id").alias("doc_id"), F.lit("t").alias("title"), F.lit("one two three four five six").alias("body"))
    assert neardup.similar_pairs(df).count() == 300 * 299 // 2


# Names


ENTITY = "entity_id string, name string, node_type string, aliases array<string>, description string, official_domain string"


def test_spellings():
    common, forms = frozenset(["quimora", "dulf"]), {"quimora": frozenset(["dulf"]), "dulf": frozenset(["quimora"])}
    p = lambda s: names.parse_person(s, common)
    assert p("Smaplebubru, Quimora") == ("smaplebubru", ["quimora"]) and p("Tibokroto Quimroa") == ("tibokroto", ["quimroa"]) and p("Dr.") is None and p("the founder") is None
    assert names.person_level(p("Sir Dulf Ludidato"), p("Ludidato, Quimora"), forms) == 2
    assert names.person_level(p("D. Drarigatri"), p("Quimora Drarigatri"), forms) == 1
    assert names.person_level(p("Ottoline Ludidato"), p("Quimora Ludidato"), forms) == 0
    words = {"textiles": 40, "foods": 40, "coastal": 30, "software": 30, "fds": 14}
    o = lambda s: names.parse_org(s, words)
    assert names.org_level(o("Nirulgulval Textiles Gesellschaft mbH"), o("Nirulgulval Textiles GmbH")) == 2
    assert names.org_level(o("Stukastako Software University"), o("Stukastako Textiles Ltd")) == 0
    assert names.org_level(o("Torulufen, Fds. Coastal"), o("Torulufen Coastal Foods Foundation")) == 2
    assert o("HQ")[0] == "" and o("the agency") is None and o("") is None and p("") is None


@given(st.text("abcd", min_size=4, max_size=7), st.text("abcd", min_size=4, max_size=7))
def test_near_words_share_a_block(a, b):
    if names.near(a, b):
        assert set(names.deletions(a)) & set(names.deletions(b))


def test_resolution(spark):
    rows = [
        ("e1", "Margaret Lostilanve", "Person", [], "Surgeon", None), ("e2", "Lostilanve, Maragret", "Person", None, "", None), ("e3", "M. Lostilanwe", "Person", ["staff"], None, None),
        ("e4", "Ursula Lostilanve", "Person", [], "Baker", None), ("e5", "MEL", "Organization", ["Melemmikro Ltd"], None, None), ("e6", "Melemmikro Limited", "Organization", [], None, None),
        ("e7", "Melemmikro GmbH", "Organization", [], None, None), ("e8", None, "Person", None, None, None), ("e9", "", "Organization", ["HQ"], None, None), (None, "Margaret Lostilanve", "Person", None, None, None),
        ("p1", "Margaret Lostilanve", "Place", [], None, None), ("e1", "Margaret Lostilanve", "Person", [], "Surgeon", None),
    ]
    df = spark.createDataFrame(rows, ENTITY).withColumn("pid", F.lit(1)).withColumn("kind", F.lit(1))
    got = {tuple(r) for r in entities.linked_pairs(df).collect()}
    assert got == {("e1", "e2"), ("e1", "e3"), ("e2", "e3"), ("e5", "e6")}
    assert entities.resolve(df.limit(0)).count() == 0


def test_forms_of_names_are_learned(spark):
    # Invented given names, forms, trades and phrases: none of them is in any table of the code.
    rng = random.Random(21)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    word = lambda n: "".join(syllable() for _ in range(n)).capitalize()
    given = {word(4): (word(3), word(2)) for _ in range(6)}
    trades, towns = [word(4).lower() for _ in range(5)], [word(3) for _ in range(12)]
    rows, want = [], set()
    for n in range(150):
        full, sur = rng.choice(list(given)), word(5)
        one, two = given[full]
        trade, town = rng.choice(trades), rng.choice(towns)
        mine = [(f"{full} {sur}", f"Lives as {trade} at {town}"), (f"{one} {sur}", rng.choice([None, f"At {town}, known as {trade}"])), (f"{sur}, {two}", None)]
        rows += [(f"{n:03d}{k}", name, "Person", [f"{full} {sur}"] if rng.random() < 0.4 and k else [], text, None) for k, (name, text) in enumerate(mine)]
        want |= set(combinations([f"{n:03d}{k}" for k in range(3)], 2))
    got = {tuple(r) for r in entities.linked_pairs(spark.createDataFrame(rows, ENTITY)).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)
    kept = [r for r in rows if not r[3]]  # without any second spelling only sameness of all else can teach
    assert {tuple(r) for r in entities.linked_pairs(spark.createDataFrame(kept, ENTITY)).collect()} <= want


def test_initials_answer_to_the_full_profile(spark):
    schema = "entity_id string, node_type string, name string, aliases array<string>, description string, official_domain string"
    rows = [("a", "Elizabeth Vinvatrodor"), ("b", "E. Vinvatsodor"), ("c", "E. Vynvatrodor"), ("d", "Dorothy Kaltrunugo"), ("e", "Daniel Kaltrunugo"), ("f", "D. Kaltrunugo")]
    df = spark.createDataFrame([(i, "Person", n, None, None, None) for i, n in rows], schema)
    got = {tuple(r) for r in entities.linked_pairs(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}  # F answers to two full profiles and stays alone


def test_common_abbreviations_and_copies(spark):
    rng = random.Random(11)
    own = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(6)).capitalize() for _ in range(61)]
    rows = [(f"{n:02d}{x}", f"{o} {w}") for n, o in enumerate(own[:60]) for x, w in (("a", "Publ."), ("b", "Publishing Ltd"), ("c", "Textiles Ltd"))]
    rows += [(f"z{n:02d}", f"{own[60]} Ltd") for n in range(60)]  # copies of one name
    schema = "entity_id string, node_type string, name string, aliases array<string>, description string, official_domain string"
    df = spark.createDataFrame([(i, "Organization", n, None, None, None) for i, n in rows], schema)
    got = {tuple(r) for r in entities.linked_pairs(df).collect()}
    assert got == {(f"{n:02d}a", f"{n:02d}b") for n in range(60)} | set(combinations([i for i, _ in rows if i[0] == "z"], 2))
    blue = spark.createDataFrame([("Organization", f"{o} Bluewhale", None) for o in own], "kind string, name string, aliases array<string>")
    common = entities.common_words(blue)["Organization"]
    assert set(common) == {"bluewhale"} and names.parse_org("Bluewhale Ltd", common) == ("bluewhale", ["limited"])


def test_rounds_go_on_until_nothing_merges(spark):
    # Each name is near the next only, and agrees in its domain with the one before: one merge a round.
    own = ["u" * n + "qwzxvkjqwzxvkj"[n:] for n in range(12)]
    hosts = [".".join(own[k::2]) + ".example" for k in (0, 1)]
    rows = [(f"{n:02d}", "Organization", o.capitalize() + (" Energy" if n < 2 else ""), None, None, hosts[n % 2]) for n, o in enumerate(own)]
    df = spark.createDataFrame(rows, "entity_id string, node_type string, name string, aliases array<string>, description string, official_domain string")
    assert {r["cluster_id"] for r in entities.resolve(df).collect()} == {"00"}


def test_no_join_goes_through_the_driver(spark):
    rows = [("a", "Elizabeth Vinvatrodor", "Person", [], "Surgeon", None), ("b", "E. Vinvatsodor", "Person", [], None, None), ("c", "Melemmikro Ltd", "Organization", [], None, None), ("d", "Melemmikro Limited", "Organization", [], None, None)]
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    began = store.executionsList().last().executionId() if store.executionsCount() else -1
    assert {tuple(r) for r in entities.linked_pairs(spark.createDataFrame(rows, ENTITY)).collect()} == {("a", "b"), ("c", "d")}
    bus.waitUntilEmpty()
    runs, ran = store.executionsList(), []
    for n in range(runs.size()):
        if (i := runs.apply(n).executionId()) > began:
            nodes = store.planGraph(i).allNodes()
            ran += [nodes.apply(k).name() for k in range(nodes.size())]
    assert "SortMergeJoin" in ran and not [x for x in ran if x.startswith("Broadcast")]


# Boilerplate


def test_tree_matching():
    nodes = boilerplate.Nodes()
    n = lambda line: nodes.find(boilerplate.shape(line, w := boilerplate.line_words(line)), w, add=True)
    home, skip, text = n("Home"), n("Skip to content"), n("One two three four five six.")
    assert n("One two three four five seven.") == text and n("One six five four three two.") not in (home, skip, text)
    place = {home: 0, skip: 1, text: 2}
    # The text weighs more than the link that stands on its wrong side.
    assert boilerplate.tree_match([(home, 2.0), (text, 7.0), (skip, 4.0)], place) == [0, 1]
    assert boilerplate.tree_match([], place) == [] and boilerplate.tree_match([(99, 1.0)], place) == []
    assert boilerplate.common_series(list("abcbdab"), list("bdcaba")) == 4


def test_matching_is_the_heaviest_ordered_one():
    rng = random.Random(12)
    for _ in range(40):
        place = {n: n for n in range(5)}
        lines = [(rng.randrange(6), float(rng.randint(1, 5))) for _ in range(7)]
        fits = (c for k in range(8) for c in combinations(range(7), k) if all(lines[x][0] in place for x in c) and all(lines[x][0] < lines[y][0] for x, y in zip(c, c[1:])))
        best = max(sum(lines[x][1] for x in c) for c in fits)
        assert sum(lines[x][1] for x in boilerplate.tree_match(lines, place)) == best


def test_many_equal_lines_and_a_long_one():
    began = time.time()
    pages = ["\n".join([f"same line {k % 3} of many."] * 5000 + [f"word{k} " * 60000, f"own text {k}."]) for k in range(6)]
    labels, _, _ = boilerplate.group_labels(pages)
    assert time.time() - began < 30 and all(len(x) == 5002 for x in labels if x)


def test_alignment_decides(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("bcdfghklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    sent = lambda: (" ".join(rng.choice(vocab) for _ in range(14))).capitalize() + "."
    about = sent()  # content words, but the same on every page of the host
    host = [(f"a{n:02d}", "a.example", "", "\n".join(["Home | News", sent(), about, sent(), "Contact us"]), [], []) for n in range(12)]
    got = {tuple(r)[::2] for r in boilerplate.article(spark.createDataFrame(host, WEB)).collect()}
    assert got == {(r[0], k) for r in host for k in (2, 4)}
    # By words alone the constant paragraph would be article, and a varying one of template words would not.
    words, mixed = np.full(boilerplate.CELLS, 2.0), np.full(boilerplate.CELLS, -1.0)
    lines = lambda labels, odds: boilerplate.article_lines("", host[0][3], [], labels, odds, {})
    assert lines("tvtvt", words) == [2, 4] and lines(None, words) == [2, 3, 4]
    assert lines("tvtvt", mixed) == [2, 4] and lines(None, mixed) == []


def test_only_lines_in_doubt_are_scored(monkeypatch):
    text = "The ferry pilot brings the boat across the wide bay at night in any weather."
    body = "\n".join(["Home | News", text, "Share this page with all the friends you have and ask them what they think of it.", "Next"])
    scored, score = [], boilerplate.line_score
    monkeypatch.setattr(boilerplate, "line_score", lambda ws, *rest: scored.append(ws) or score(ws, *rest))
    assert boilerplate.article_lines("A night on the bay", body, None, "tvtv", np.zeros(boilerplate.CELLS), {}) == [2]
    assert scored == [boilerplate.line_words(text)]  # template and menus are settled without their words


def test_near_copies_and_nodes_by_definition():
    rng = random.Random(8)
    stock = [[rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(rng.randint(3, 14))] for _ in range(9)]
    edit = lambda ws: [w if rng.random() < 0.9 else rng.choice("mnopq") for w in ws]
    for _ in range(20):
        pages = list({" ".join(w for ws in rng.sample(stock, 4) for w in edit(ws)) for _ in range(12)})
        sets = {p: set(zip(p.split(), p.split()[1:])) for p in pages}
        weight = lambda xs: sum(np.log((len(pages) + 1) / sum(x in s for s in sets.values())) for x in xs)
        root = {p: {p} for p in pages}
        for p, q in combinations(pages, 2):
            if weight(sets[p] & sets[q]) >= boilerplate.NEAR_COPY * weight(sets[p] | sets[q]):
                for r in (both := root[p] | root[q]):
                    root[r] = both
        kept = boilerplate.different(pages)
        assert len(kept) == len({frozenset(r) for r in root.values()}) == len({frozenset(root[p]) for p in kept})
        nodes, first = boilerplate.Nodes(), []
        for ws in dict.fromkeys(tuple(edit(rng.choice(stock))) for _ in range(40)):
            like = [(boilerplate.common_series(list(ws), f) / max(len(ws), len(f)), -n) for n, f in enumerate(first)]
            best = max((x for x in like if x[0] >= boilerplate.SAME_NODE - 1e-12), default=None)
            assert nodes.find("p", list(ws), add=True) == (len(first) if best is None else -best[1])
            if best is None:
                first.append(list(ws))


def test_article(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("bcdfghklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    sent = lambda: (" ".join(rng.choice(vocab) for _ in range(14))).capitalize() + "."
    rows, want = [], set()
    for n in range(60):
        title = " ".join(rng.choice(vocab) for _ in range(5))
        body = ["Home | News | Shop", title, sent() + " " + sent(), "Advertisement", sent() + " " + sent(), "", "Sign up for the Acme newsletter and never miss a story from us again today.", "Contact us"]
        rows.append((f"d{n}", "a.example", title, "\n".join(body), [], ["\n".join(body[:3]), "\n".join(body[6:])]))
        want |= {(f"d{n}", "line", k) for k in (2, 3, 5)} | {(f"d{n}", "chunk", 1)}
    rows += [("z1", None, None, None, None, None), ("z2", "a.example", None, "", None, None), ("z3", None, None, "Contact us", None, [None])]
    df = spark.createDataFrame(rows, WEB).withColumn("id", F.lit(0)).withColumn("group", F.lit(0))
    got = {tuple(r) for r in boilerplate.article(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 3
    assert boilerplate.article(df.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("bcdfghklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    sent = lambda words: (" ".join(rng.choice(words) for _ in range(14))).capitalize() + "."
    menu, foot = "Home | News | Shop", "Sign up for the Acme newsletter and never miss a story from us again today."
    text = [sent(vocab[:300]) for _ in range(4)]
    rows = []
    for n in range(40):
        mine = [*text[:3], f"{text[3]} Note {n}."] if n < 20 else [sent(vocab[300:]) for _ in range(4)]
        rows.append((f"d{n:02d}", "a.example", "", "\n".join([menu, *mine, foot]), [], []))
    assert len(boilerplate.different([r[3] for r in rows])) == 21
    labels, template, content = boilerplate.group_labels([r[3] for r in rows])
    assert set(labels) == {"tvvvvt"}
    assert boilerplate.line_words(foot) in template and not [t for t in text if boilerplate.line_words(t) in template]
    got = {tuple(r) for r in boilerplate.article(spark.createDataFrame(rows, WEB)).where("unit = 'line'").collect()}
    assert got == {(r[0], "line", k) for r in rows for k in (2, 3, 4, 5)}


# Mixing


def test_feasible():
    t = [{"source": "a", "target_share": 0.5, "max_repeats": 1}, {"source": "b", "target_share": 0.4, "max_repeats": 3}, {"source": "c", "target_share": 0.1, "max_repeats": 2}]
    got = mixing.feasible(t, {"a": 20, "b": 80})
    assert got["a"] == 20 and got["c"] == 0 and abs(got["b"] - 80) < 1e-9


def test_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(-1, None, "en", "answer", 0, None, None), (-2, "text", "en", None, 4, None, None)], spark.read.parquet(f"{SF}/documents.parquet").schema))
    chosen, shares, margins = mixing.mixture(docs, spark.read.parquet(f"{SF}/mix_targets.parquet"))
    rows, s = chosen.collect(), {r["source"]: r for r in shares.collect()}
    assert not {r["doc_id"] for r in rows} & {-1, -2} and all(r["copies"] <= s[r["source"]]["max_repeats"] for r in rows)
    total = sum(r["tokens_available"] for r in s.values())
    most = max(r["tokens"] for r in rows)
    assert all(abs(r["tokens_used"] - r["feasible_share"] * total) <= most for r in s.values())
    m = margins.collect()
    assert {r["margin"] for r in m} == {"source", "lang", "topic"}
    for name in ("source", "lang", "topic"):
        for share in ("goal_share", "raked_share", "actual_share"):
            assert abs(sum(r[share] for r in m if r["margin"] == name) - 1) < 0.05
    assert all(abs(r["raked_share"] - r["goal_share"]) < 1e-3 for r in m if r["margin"] == "source")
    empty, none, _ = mixing.mixture(docs.limit(0), spark.read.parquet(f"{SF}/mix_targets.parquet"))
    assert empty.count() == 0 and all(r["actual_share"] == 0 for r in none.collect())


def test_raking_meets_margins_that_agree():
    cells = [{"source": s, "lang": x, "topic": t, "tokens": n} for n, (s, x, t) in enumerate(((s, x, t) for s in "ab" for x in "xy" for t in "pq"), 10)]
    total = sum(c["tokens"] for c in cells)
    size = {m: {k: sum(c["tokens"] for c in cells if c[m] == k) for k in sorted({c[m] for c in cells})} for m in mixing.MARGINS}
    goals = {"source": {"a": 0.6 * total, "b": 0.4 * total}, "lang": {"x": 0.45 * total, "y": 0.55 * total}, "topic": size["topic"]}
    f = mixing.rake(cells, goals, {"a": 3, "b": 3}, size["source"])
    for m in mixing.MARGINS:
        for k, want in goals[m].items():
            assert abs(sum(c["tokens"] * f["source"][c["source"]] * f["lang"][c["lang"]] * f["topic"][c["topic"]] for c in cells if c[m] == k) - want) < 1e-3 * total
    # Margins that contradict each other: the source still gets its goal, within its cap.
    tied = [{"source": "a", "lang": "x", "topic": "p", "tokens": 50}, {"source": "b", "lang": "y", "topic": "q", "tokens": 50}]
    goals = {"source": {"a": 70, "b": 30}, "lang": {"x": 50, "y": 50}, "topic": {"p": 50, "q": 50}}
    f = mixing.rake(tied, goals, {"a": 2, "b": 2}, {"a": 50, "b": 50})
    assert abs(50 * f["source"]["a"] * f["lang"]["x"] * f["topic"]["p"] - 70) < 1e-6


# Look-alikes


def canonical(spark, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id int, text string").withColumn("unit", F.lit("c")).withColumn("form", F.lit("c"))
    return [r["form"] for r in sorted(lookalike.canonical(df).collect(), key=lambda r: r["doc_id"])]


def test_forms(spark):
    got = canonical(spark, ["e\u0301\u0323x", "\u1eb9\u0301x", "ｆｕｌｌ　ｗｉｄｔｈ", "full width", "р\u200bаy\u00a0x", "pay x", None, "", "\u200b", "👨\u200d👩\u200d👧 ❤\ufe0f", "x²", "ｶﾞ", "ガ", "\u1112\u1161\u11ab", "한", "a\r\nb", "𝔞ǆ"])
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] == "pay x" and got[6] is None and got[7] == "" and got[8] == ""
    assert got[9] == "👨\u200d👩\u200d👧 ❤\ufe0f" and got[10] == "x²" and got[11] == got[12] == "ガ" and got[13] == got[14] == "한" and got[15] == "a\nb" and got[16] == "𝔞ǆ"


def test_plain_characters_stay():
    ranges = re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", lookalike.PLAIN)
    plain = {c for a, b in ranges for c in range(int(a, 16), int(b or a, 16) + 1)}
    alike = {ord(a) for x, _ in lookalike.LOOKALIKES.values() for a in x}
    assert not plain & alike
    for c in plain:
        d = unicodedata.normalize("NFD", chr(c))
        assert unicodedata.normalize("NFC", d) == chr(c) and not {ord(x) for x in d} & alike and not unicodedata.combining(chr(c)), hex(c)
        assert unicodedata.category(chr(c)) not in ("Zs", "Cf") or c == 0x20, hex(c)
    assert all(len(a) == len(b) for a, b in lookalike.LOOKALIKES.values())


def test_alike_pairs(spark):
    rows = [(1, "Cafe\u0301"), (2, "Café"), (3, "Café"), (4, "Cafe"), (5, "\u200b"), (6, " "), (7, None), (8, "CAFÉ"), (2, "Café")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in lookalike.alike_pairs(df).collect()} == {(1, 2), (1, 3)}
    assert lookalike.alike_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("s", ["", "a b", "x" * 10])
def test_short_pages_have_no_shingles(s):
    assert len(neardup.shingles(neardup._hashes(neardup.words(None, s))[0])) == 0
