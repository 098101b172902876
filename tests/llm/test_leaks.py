import random

import pytest

from weft.llm.leaks import Automaton, best_chain, find_leaks, fold

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
ITEM = " ".join(WORDS[:60])


def held(text, item=ITEM):
    return {h[0]: h[1] for h in Automaton([(1, item)]).find(text)}


def test_whole_and_partial():
    assert held(f"before {ITEM} after") == {1: 60}
    assert held("x " + " ".join(WORDS[10:30]) + " y") == {1: 20}
    assert held("x " + " ".join(WORDS[10:29]) + " y") == {}
    assert held("unrelated text of many words that says nothing of it") == {}


def test_stretches_in_order():
    parts = [WORDS[0:7], WORDS[20:27], WORDS[40:46]]
    assert held(" filler here ".join(map(" ".join, parts))) == {1: 20}
    assert held(" filler here ".join(map(" ".join, parts[::-1]))) == {}
    assert held(" filler ".join(" ".join(WORDS[i : i + 5]) for i in range(0, 60, 5))) == {}


@pytest.mark.parametrize(
    "change",
    [
        str.upper,
        lambda t: t.replace(" ", "\n> "),
        lambda t: t.replace(" ", "&nbsp;"),
        lambda t: "<p>" + " ".join(f"<b>{w}</b>" for w in t.split()) + "</p>",
        lambda t: t.replace("w", "w​"),
        lambda t: t.replace("a", "а"),
        lambda t: t.replace("wa", "w­a"),
        lambda t: t.replace("wba", "w-\n   ba"),
        lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in t),
        lambda t: t.replace("e", "é"),
        lambda t: ", ".join(t.split()) + ".",
        lambda t: "| " + " | ".join(t.split()) + " |",
    ],
)
def test_however_it_is_typed(change):
    assert held("start " + change(ITEM) + " end") == {1: 60}


def test_places_in_the_original():
    text = "<p>say &amp; tell</p> <b>" + ITEM.upper().replace(" ", "&nbsp;") + "</b> end"
    [(item, words, a, b)] = Automaton([(1, ITEM)]).find(text)
    assert (item, words) == (1, 60) and text[a:b] == ITEM.upper().replace(" ", "&nbsp;")


def test_short_and_empty_items():
    a = Automaton([(1, None), (2, ""), (3, "only five words are here"), (4, "now exactly six words are here")])
    assert a.find("only five words are here now exactly six words are here") == [(4, 6, 25, 55)]
    assert Automaton([]).find("anything") == []


def test_best_chain_is_quick_with_many_repeats():
    rnd = random.Random(1)
    stretches = [(d, rnd.randrange(50), 6) for d in range(0, 60_000, 7)]
    total, chain = best_chain(stretches)
    assert total >= 42 and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:]))


def test_fold():
    assert [fold(w) for w in ("Don't", "CAFÉ", "ﬁne", "Ｗｉｄｅ", "сосоа", "x-\ny")] == ["dont", "cafe", "fine", "wide", "cocoa", "xy"]


def test_table(spark):
    docs = [(1, f"a {ITEM} b", "clash"), (2, None, None), (3, "", None), (4, "z " * 300_000 + ITEM, None), (1, f"a {ITEM} b", None), (None, ITEM, None)]
    items = [(10, ITEM), (11, ITEM), (12, None), (13, "few"), (None, ITEM)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id, r.words) for r in got.collect()), key=str) == sorted([(d, i, 60) for d in (1, 1, 4, None) for i in (10, 11)], key=str)


def test_blocks_of_items(spark, monkeypatch):
    import weft.llm.leaks as leaks

    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    items = [(k, " ".join(WORDS[k * 30 : k * 30 + 30])) for k in range(12)]
    docs = [(k, "say " + t) for k, t in items]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k in range(12)}
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one scan for all blocks
    monkeypatch.setattr(leaks, "BLOCKS", 5)
    more = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("size", [10, 2_400, 24_000, 3_000_000])
def test_comments_of_any_length_are_no_text(size):
    words = ITEM.split()
    assert held(f"x {' '.join(words[:4])} <!-- {'note ' * (size // 5)} --> {' '.join(words[4:24])} y") == {1: 24}
    assert held(f"x <!-- {ITEM} --> y") == {}


def test_what_no_reader_sees():
    words = ITEM.split()
    for hidden in ("<style>p { color: red }</style>", "<SCRIPT type='x'>var a = 1 < 2;</SCRIPT >", "<script>" + ITEM[:50] + "</script>"):
        assert held(f"x {' '.join(words[:4])} {hidden} {' '.join(words[4:24])} y") == {1: 24}
    assert held(f"x <script>{ITEM}</script> y") == {}
    assert held(f"x <script> {ITEM} y") == held(f"x <!-- {ITEM} y") == held(f"x <script/> {ITEM} y") == {1: 60}


def test_unclosed_marks_are_quick():
    for mark in ("<!-- ", "<script> ", "<style>", "<", "&", "<!-- x --> "):
        assert held(mark * 100_000 + ITEM) == {1: 60}


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(d, i).count() == 0
    assert find_leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), i).count() == 0
