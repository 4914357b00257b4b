"""The language-model operators: edge cases, brute force and round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspread.llm import encode as en
from larkspread.llm import leaks as lk
from larkspread.llm import pii
from larkspread.llm.mentions import mentions, view
from larkspread.llm.runs import agglomerate, collapse_runs

# --- 4: runs ----------------------------------------------------------------------

EVENTS = "id long, sym string, ns long, upd long, bp string, bq string, ap string, aq string"
HOUR = 3_600_000_000_000


def _collapse(df, **more):
    return collapse_runs(df, "sym", "ns", "upd", ("bp", "ap"), ("bq", "aq"), tie="id", once=True, **more)


def _brute(rows):
    """Runs of (entity, day) in order, each message once, by comparing neighbours."""
    seen, once = set(), []
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        if (r[1], r[2], r[3]) not in seen:
            seen.add((r[1], r[2], r[3]))
            once.append(r)
    out = []
    for r in once:
        key = (r[1], r[2] // (24 * HOUR))
        v = tuple(float(x) for x in r[4:])
        last = out[-1] if out else None
        if last and last[0] == key and v[0] == last[5][0] and v[2] == last[5][2] and all(abs(v[k] - last[5][k]) <= 0.001 * max(v[k], last[5][k]) for k in (1, 3)):
            out[-1] = (key, last[1], r[2], last[3], r[3], v, last[6] + 1)
        else:
            out.append((key, r[2], r[2], r[3], r[3], v, 1))
    return sorted((k[0], a, b, f, e, n) for k, a, b, f, e, _, n in out)


def test_runs_equal_brute_force(spark):
    rng = random.Random(2)
    rows, size = [], 100.0
    for i in range(1500):
        ns = rng.randrange(30) * HOUR // 4 + rng.randrange(40) * 1_000_000_000
        size = rng.choice([size, size * 1.0005, rng.choice([100.0, 200.0])])
        rows.append((i, rng.choice("AB"), ns, rng.randrange(3), rng.choice(["5", "5.0"]), repr(size), "6", "1e1"))
    rows += [(5000 + i, *r[1:]) for i, r in enumerate(rows[:200])]
    df = spark.createDataFrame(rows, EVENTS)
    get = lambda d: sorted((r.sym, r.start_ns, r.end_ns, r.first_upd, r.last_upd, r.n) for r in d.collect())
    want = _brute(rows)
    assert get(_collapse(df)) == want
    assert get(_collapse(df, bucket_ns=2_000_000_000)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert get(_collapse(df, bucket_ns=24 * HOUR, buffer_rows=10)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert get(_collapse(df, at_least=2)) == [w for w in want if w[-1] >= 2]


def test_limits_gaps_and_days(spark):
    rows = [(1, "A", 10, 1, "5", "999", "6", "0"), (2, "A", 20, 2, "5.00", "1000", "6", "0"), (3, "A", 500, 3, "5", "1000", "6", "0"), (4, "A", 501, 4, "5", "1002", "6", "0"), (5, "A", 24 * HOUR, 5, "5", "1002", "6", "0")]
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted((r.first_upd, r.last_upd, r.n, r.duration_ns) for r in _collapse(df).collect()) == [(1, 3, 3, 490), (4, 4, 1, 0), (5, 5, 1, 0)]
    assert sorted((r.first_upd, r.last_upd) for r in _collapse(df, gap_ns=100).collect()) == [(1, 2), (3, 3), (4, 4), (5, 5)]


def test_runs_edge_cases(spark):
    rows = [(1, None, 1, 1, "5", "1", "6", "1"), (2, "A", None, 1, "5", "1", "6", "1"), (3, "A", 1, None, "5", "1", "6", "1"), (4, "A", 2, 1, None, "1", "6", "1"), (5, "A", 3, 2, "x", "1", "6", "1"), (6, "A", 4, 3, "x", "1", "6", "1")]
    df = spark.createDataFrame(rows, EVENTS).withColumn("edge", F.lit(1)).withColumn("bucket", F.lit("b"))
    assert sorted((r.start_ns, r.n) for r in _collapse(df).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert _collapse(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from([0.0, 0.1, 0.5, float("inf")]), max_size=12))
def test_agglomeration_joins_all_that_may_be_joined(d):
    number = agglomerate(np.array(d)).tolist()
    assert number == [0] + [sum(x == float("inf") for x in d[: i + 1]) for i in range(len(d))]


# --- 6: encoding ------------------------------------------------------------------

VOCABULARY = en.load_vocabulary("byte_bpe_50k", en.vocabulary_folder())


@given(st.text("a b'srelvmdtL \n\t19é中 .,!  \r", max_size=50), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_tree_equals_one_pass(text, piece):
    e = en.encode_tree(VOCABULARY, text, piece)
    assert e.ids == VOCABULARY.ids(text)
    assert en.decode_tree(VOCABULARY, e.ids, 3) == text


@given(st.text(max_size=80), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_tree_equals_one_pass_on_any_text(text, piece):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert en.encode_tree(VOCABULARY, text, piece).ids == VOCABULARY.ids(text)


def test_products_associate():
    rng = random.Random(1)
    for _ in range(200):
        parts = ["".join(rng.choice("ab 's\n1.") for _ in range(rng.randrange(6))) for _ in range(3)]
        a, b, c = (en.leaf(VOCABULARY, p) for p in parts)
        left = en.join(VOCABULARY, en.join(VOCABULARY, a, b), c)
        right = en.join(VOCABULARY, a, en.join(VOCABULARY, b, c))
        assert left.ids == right.ids == VOCABULARY.ids("".join(parts)) and left.settled == right.settled


def test_ids_equal_the_other_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", None, "  ", "<|endoftext|> it's", "a" * 9000 + "'re", "it's  we'll \n\n " * 900, "é中\U0001f9ee" * 10, "\x00\x1c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("mine"))
    got = {r.doc_id: r.ids for r in en.encode_column(df, "doc_id", "text").collect()}
    for i, text in enumerate(texts):
        assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else []), i
    back = {r.doc_id: r.text for r in en.decode_column(en.encode_column(df, "doc_id", "text"), "doc_id").collect()}
    assert all(back[i] == (text or "") for i, text in enumerate(texts))
    assert en.encode_column(df.limit(0), "doc_id", "text").count() == 0


@given(st.text("a b'srelvmdtL \n\t19é中 .,!  \r", max_size=120))
@settings(max_examples=300, deadline=None)
def test_unsettled_end_is_found_from_the_end(text):
    assert en._unsettled(VOCABULARY, text) == en._settled(VOCABULARY, text, 0)


def test_long_posts_are_joined_from_halves(monkeypatch):
    joins, join = [], en.join
    monkeypatch.setattr(en, "join", lambda *a: joins.append(1) or join(*a))
    post = ("> Don't sell at 10:35 \n\n  they'll pay 1234567 € for naïve 東京 quotes… " * 40)[:1714]
    assert en.encode_text(VOCABULARY, post) == VOCABULARY.ids(post) and joins


# --- 7: leaks ---------------------------------------------------------------------

ITEM = "the sworn appraiser of the dormant board swaps tokens with the damp remains of tallow options found after the fire whether or not her own ledger loses feathers and a sleepless clerk misplaces every second crate of stale bids from the abandoned pit"
OTHER = "an overpaid keeper near the hall quotes prices twice to every careful merchant who seals envelopes for a crooked pile of wax awaiting the second stamp long before any copper gauge owes pennies to strangers"


def _leaks(spark, texts, items=((1, ITEM), (2, OTHER)), **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    its = spark.createDataFrame(list(items), "item_id long, question string")
    return lk.find_leaks(docs, its, limits=lk.LeakLimits(**limits)), docs


def test_passages_are_found_in_any_dress(spark):
    w = ITEM.split()
    changed = [x if i % 8 != 4 else "other" for i, x in enumerate(w)]
    dropped = [x for i, x in enumerate(w) if i % 8 != 5]
    added = [y for i, x in enumerate(w) for y in ((x, "uh") if i % 8 == 3 else (x,))]
    texts = [
        "See. " + ITEM.upper() + "!",
        "\n".join("> > " + " ".join(w[i : i + 6]) for i in range(3, 33, 6)),
        "<b>" + "</b> <i>".join(w[5:27]) + "</i>",
        " ".join(changed[:30]),
        " ".join(dropped[:28]),
        " ".join(added[:34]),
        "x " + " ".join(w[2:14]) + " (now something else came in between, it was long) " + " ".join(w[14:28]),
        " ".join(w[4:15]) + " and nothing more",
        " ".join(w[4:10]) + " some text " + " ".join(w[20:26]),
        "​".join(" ".join(w[0:24])),
        None,
        "",
        "<p></p> --- ",
        "copper gauge owes pennies",
    ]
    leaks, docs = _leaks(spark, texts)
    got = {(r.doc_id, r.item_id) for r in leaks.collect()}
    assert got == {(i, 1) for i in (0, 1, 2, 3, 4, 5, 6, 9)}
    clean = {r.doc_id: r.text for r in lk.strip_leaks(docs, leaks).collect()}
    assert clean[0] == "See. !" and clean[7] == texts[7] and clean[10] is None and clean[11] == ""


def test_leaks_edge_cases(spark):
    leaks, _ = _leaks(spark, [ITEM + " " + OTHER, ITEM], items=((1, ITEM), (2, ITEM), (3, None), (None, ITEM), (4, OTHER), (5, "too short")), group_chars=250)
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == {(0, 1), (0, 2), (0, 4), (1, 1), (1, 2)}
    none, _ = _leaks(spark, [ITEM], items=((3, None),))
    assert none.count() == 0
    long, _ = _leaks(spark, ["filler word " * 200_000 + ITEM])
    assert {(r.doc_id, r.item_id) for r in long.collect()} == {(0, 1)}


def test_passages_are_not_hidden_by_poor_matches_after_or_before_them():
    w = ITEM.split()
    other = ["foreign"] * 12
    mixed = [*other[:5], *w[25:28], *other[:5], *w[33:36], *other[:4], *w[40:43]]
    texts = [
        w[:20] + other + w[32:35],
        w[:20] + mixed,
        w[:3] + other + w[15:35],
        w[:14] + other + w[26:29],
        w[:12] + [*other[:7], *w[19:22], *other[:5], *w[27:30], *other[:4], *w[34:37]],
    ]
    automaton, limits = lk.ItemAutomaton([(1, w)]), lk.LeakLimits()
    best = [max(lk.passages(automaton, t, limits), key=lambda p: lk.is_leak(p, limits)) for t in texts]
    assert [lk.is_leak(p, limits) for p in best] == [True, True, True, False, False]
    assert (best[0].item_from, best[0].item_to, best[0].common) == (0, 20, 20)
    assert best[1].item_from == 0 and best[1].item_to >= 20 and (best[2].item_from, best[2].item_to) == (15, 35)


def test_a_passage_may_be_interrupted_once_at_any_length():
    w = ITEM.split()
    texts = [
        w[:11] + ["x"] * 3000 + w[11:22],
        w[:11] + ["x"] * 500 + ["changed"] + w[12:23],
        w[:11] + [w[11], "x"] + ["y"] * 500 + ["x", w[13]] + w[14:24],
        w[:8] + ["x"] * 500 + w[8:16],
        w[:8] + ["x"] * 500 + w[8:15] + ["x"] * 500 + w[15:22],
        w[11:22] + ["x"] * 500 + w[:11],
    ]
    automaton, limits = lk.ItemAutomaton([(1, w)]), lk.LeakLimits()
    assert [any(lk.is_leak(p, limits) for p in lk.passages(automaton, t, limits)) for t in texts] == [True, True, True, False, False, False]


def _near_items(rng, n=6):
    """Items that share passages of 18 to 30 words with one another."""
    pool = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(pool) for _ in range(rng.randrange(18, 31))] for _ in range(3)]
    return [(k, [rng.choice(pool) for _ in range(rng.randrange(25))] + rng.choice(shared) + [rng.choice(pool) for _ in range(rng.randrange(25))]) for k in range(n)]


def test_an_item_is_found_whatever_other_items_there_are(spark):
    rng, limits = random.Random(7), lk.LeakLimits()
    several = 0
    for _ in range(40):
        items = _near_items(rng)
        words = ["so"] * 5
        for k in rng.sample(range(len(items)), 2):
            part = list(items[k][1])
            for j in range(4, len(part), 9):
                part[j] = "changed"
            words += part + ["then"] * 6
        get = lambda a: {(a.items[p.item][0], p.item_from, p.item_to, p.text_from, p.text_to) for p in lk.passages(a, words, limits) if lk.is_leak(p, limits)}  # noqa: B023, E731
        alone = set().union(*(get(lk.ItemAutomaton([item])) for item in items))
        assert get(lk.ItemAutomaton(items)) == alone
        several += len({k for k, *_ in alone}) > 2
    assert several
    a, b = ITEM.split(), ["quite", "other"] + ITEM.split()[5:28] + ["end"]
    texts = [" ".join(a), " ".join(b), None]
    want = {(0, 1), (0, 2), (1, 1), (1, 2)}
    for chars in (10, 250, 4_000_000):
        leaks, docs = _leaks(spark, texts, items=((1, ITEM), (2, " ".join(b)), (3, OTHER)), group_chars=chars)
        assert {(r.doc_id, r.item_id) for r in leaks.collect()} == want


def test_all_passages_of_an_item_come_out(spark):
    w = ITEM.split()
    twice = " ".join(["one", *w, "two", *w[3:30], "three"])
    apart = " ".join([*w[:12], *(["x"] * 60), *w, *(["y"] * 60), *w[12:25]])
    leaks, docs = _leaks(spark, [twice, apart], items=((1, ITEM),))
    got = sorted((r.doc_id, r.passage, r.piece) for r in leaks.collect())
    assert got == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)]
    clean = {r.doc_id: r.text for r in lk.strip_leaks(docs, leaks).collect()}
    assert clean[0].split() == ["one", "two", "three"] and clean[1].split() == ["x"] * 60 + ["y"] * 60


def test_many_copies_cost_in_proportion():
    import time

    automaton, limits, took = lk.ItemAutomaton([(1, ITEM.split())]), lk.LeakLimits(), []
    for copies in (50, 400):
        words = (ITEM.split() + ["so", "on"]) * copies
        began = time.process_time()
        found = [p for p in lk.passages(automaton, words, limits) if lk.is_leak(p, limits)]
        took.append(time.process_time() - began)
        assert len(found) == copies
    assert took[1] < 40 * max(took[0], 0.02)


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=25))
@settings(max_examples=200, deadline=None)
def test_automaton_equals_brute_force(items, words):
    a = lk.ItemAutomaton(list(enumerate(items)))

    def occurs(part):
        return [(k, i + len(part)) for k, w in enumerate(items) for i in range(len(w) - len(part) + 1) if w[i : i + len(part)] == part]

    longest = [max((n for n in range(i + 1) if n == 0 or occurs(words[i - n : i])), default=0) for i in range(len(words) + 1)]
    want = [(i, longest[i]) for i in range(1, len(words) + 1) if longest[i] >= 1 and (i == len(words) or longest[i + 1] <= longest[i])]
    got = a.seeds(words, 1)
    assert [(e, n) for e, n, _ in got] == want
    for e, n, s in got:
        assert sorted(a.ends[s]) == sorted(occurs(words[e - n : e]))


# --- 8: personal information ------------------------------------------------------


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("Mail a.b+c@mail.example.org now", "email", "abcmailexampleorg"),
        ("a_b [at] mail [dot] invalid", "email", "abatmaildotinvalid"),
        ("zora-q at bright dot example is", "email", "zoraqatbrightdotexample"),
        ("x.y @\n> post.test, ok", "email", "xyposttest"),
        ("x＠y.test", "email", "xytest"),
        ("Call +44 (0)20 7946 0609 ext. 12", "phone", "4402079460609"),
        ("Tel: 030/23125117", "phone", "03023125117"),
        ("0049-30-23125-539\n247 Old", "phone", "00493023125539"),
        ("01632 960775", "phone", "01632960775"),
        ("(279) 555‑0137", "phone", "2795550137"),
        ("+1 888 555 0179", "phone", "18885550179"),
        ("SSN 935-42-9513.", "id_number", "935429513"),
        ("n° de sécu 9 89 99 99 361 642 66", "id_number", "989999936164266"),
        ("NI number QQ123456C", "id_number", "qq123456c"),
        ("DNI: 00840980-T", "id_number", "00840980t"),
        ("129c Millpond Mews, Apt 6B, Villacerra", "address", "129cmillpondmews"),
        ("to 173A TANNERY CRESCENT. The", "address", "173atannerycrescent"),
        ("at 82C ST. ODRANS WAY, Flat", "address", "82cstodransway"),
        ("at 204 St. Odrans Blvd on", "address", "204stodransblvd"),
        ("Bitte an Gerberstraße 27, 00454 Osterfelden", "address", "gerberstraße27"),
        ("in Am Torfgraben 183a, 00219 Eastwell", "address", "amtorfgraben183a"),
        ("au 98, rue des Tilleuls, 00141", "address", "98ruedestilleuls"),
        ("en Calle de la Noria 247, 00361", "address", "calledelanoria247"),
        ("Plaza Tejera, 6, 00972", "address", "plazatejera6"),
    ],
)
def test_shapes(text, kind, value):
    assert [(m.kind, m.value) for m in mentions(text) if m.seed] == [(kind, value)]


@pytest.mark.parametrize("text", ["Install lobkettle@3.10.7 and", "Lot size 10@1198.50 looked", "@half-rook319 hello", "file at 1709599384577.", "at 10.61.123.160", "code is ZZ4925752916", "TKT-9999-16", "On 2024-03-04 08:41:06, x", "Lane 4 of the switch", "4 Way quotes", "on Wall Street", "1162363,1177.74,92,1534.08,693", "1709986444280", "I KEEP 3 DAYS OF IT, ABOUT 41 GB PER HEADER ROW."])
def test_what_is_no_mention(text):
    assert not [m for m in mentions(text) if m.seed]


def test_view_keeps_places():
    text = "<p>a&amp;b</p>\n> > c​d <hr>e[quote=f]"
    v, places = view(text)
    assert [text[p] for p, c in zip(places, v) if c in "abcdef"] == list("abcdef")
    assert len(v) == len(places)


def _world(spark):
    given, family = ["Zora", "Anton", "Flora", "Edgar", "Wanda", "Ines"], ["Pellham", "Lundby", "Ulvley", "Korvova", "Feskmann", "Le Fennec"]
    rng = random.Random(5)
    unseen_g, unseen_f = ["Gwennis", "Leopold", "Carlo"], ["Quennell", "Wintworth", "Raskham"]
    texts, want = [], set()
    for i in range(240):
        g, f = rng.choice(given + unseen_g), rng.choice(family + unseen_f)
        name = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g} {f}".upper(), f"{g} K. {f}", f"{g} K."])
        texts.append(rng.choice(["My name is {} and I run it.", "I spoke with {} about the gap.", "Ask for {} at the desk.", "Dr. {} explained it."]).format(name) + " Rose Garden is what our screen calls it.")
        want.add((i, "".join(c for c in name.lower() if c.isalnum())))
    decoys = ["Mark Price", "Rose Garden", "Frank Opinion", "Flora Lundby"][:3]
    for i in range(240, 300):
        texts.append(f"{rng.choice(decoys)} is what our screen calls it. People at Harlow Trading told me.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([(x, "given") for x in given + ["Mark", "Rose", "Frank"]] + [(x, "family") for x in family + ["Price"]] + [(None, "given"), ("x", None)], "person_name string, name_kind string")
    return docs, names, want


def test_unseen_names_are_found_by_their_contexts(spark):
    docs, names, want = _world(spark)
    got = {(r.doc_id, r.pii_value) for r in pii.pii_mentions(docs, names).where("pii_kind = 'name'").collect()}
    assert got == want


def _labelled(rng):
    """Texts whose labels are learned from known layouts, other layouts after the same
    labels, and figures and places after words that no mention follows."""
    seeds = {
        "phone": (["Call me on {} today", "my number is {} as ever"], lambda: f"+44 20 7946 0{rng.randrange(100, 999)}"),
        "id_number": (["my ssn is {} they say", "passport number {} was on it"], lambda: f"{rng.randrange(900, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "address": (["I live at {} now", "sent the card to {} then"], lambda: f"{rng.randrange(1, 200)} {rng.choice(['Alder', 'Cobble', 'Quarrel'])} Street"),
    }
    other = {
        "phone": ["06 12 34 56 78", "(0161) 496 0123", "1-800-555-0199", "030 12345678"],
        "id_number": ["850709-9805", "K 1234567"],
        "address": ["123 5th Ave", "Via Roma 12", "Kungsgatan 14", "7 Kirkegata"],
    }
    texts, want = [], set()
    for kind, (frames, make) in seeds.items():
        for i in range(60):
            value = make()
            want.add((len(texts), kind, pii.squeeze(value)))
            texts.append(frames[i % 2].format(value))
        for value in other[kind]:
            for frame in frames:
                want.add((len(texts), kind, pii.squeeze(value)))
                texts.append(frame.format(value))
    for i in range(200):
        texts.append(rng.choice(["update {} was late", "I saw order {} fail", "the fee at {} rose"]).format(rng.choice([rng.randrange(10**8, 10**9), f"{rng.randrange(100, 999)} {rng.randrange(10**5, 10**6)}", f"Level {rng.randrange(90)}", f"{rng.randrange(90)} Lots"])))
    return texts, want


def test_other_layouts_are_found_by_their_contexts(spark):
    texts, want = _labelled(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([("Zora", "given")], "person_name string, name_kind string")
    got = {(r.doc_id, r.pii_kind, r.pii_value) for r in pii.pii_mentions(docs, names).collect() if r.pii_kind != "name"}
    assert got == want
    alone = {(r.doc_id, r.pii_value) for r in pii.pii_mentions(docs.where("doc_id IN (60, 61, 128, 129)"), names).collect()}
    assert not alone  # without texts that teach the labels, nothing tells what they are


def test_shouted_words_after_a_number_are_no_street():
    from larkspread.llm.mentions import _layout

    assert _layout("place", "857 PERCENT") == [] and _layout("place", "857 Percent")[0] == "W1 percent"
    assert _layout("address", "129C MILLPOND CRESCENT")[2] == "W3 cent"


def test_words_that_hardly_ever_precede_a_kind_refute_a_seed(spark):
    texts = [f"the fee code is {i}8{i}31{i} here" for i in range(10, 90)] + ["the fee code is (212) 555-0142 here", "phone me on (212) 555-0143 please"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([("Zora", "given")], "person_name string, name_kind string")
    got = {r.pii_value for r in pii.pii_mentions(docs, names).collect()}
    assert got == {"2125550143"}


@pytest.mark.parametrize("text,value", [("to anna[@]example[.]com please", "annaexamplecom"), ("an bo (@) mail (dot) example", "bomaildotexample"), ("an bo{at}mail{.}example", "boatmailexample")])
def test_bracketed_signs_of_addresses(text, value):
    assert [(m.kind, m.value) for m in mentions(text) if m.seed] == [("email", value)]


def test_redaction_and_edge_cases(spark):
    _, names, _ = _world(spark)
    texts = ["Mail a@b.test or a@b.test, call 030/23125117.", None, "", "   ", "<p></p>", "plain", "x" * 300_000 + " a@b.test"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_kind", F.lit("mine"))
    found = pii.pii_mentions(docs, names)
    assert sorted((r.doc_id, r.pii_kind) for r in found.collect()) == [(0, "email"), (0, "email"), (0, "phone"), (6, "email")]
    clean = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert clean[0] == "Mail [EMAIL] or [EMAIL], call [PHONE]." and clean[1] is None and clean[2] == "" and clean[5] == "plain" and clean[6].endswith("x [EMAIL]")
    assert pii.pii_mentions(docs.limit(0), names).count() == 0
    assert pii.pii_mentions(docs, names.limit(0)).count() == 4


def test_a_long_text_full_of_mentions(spark):
    import time

    text = " ".join(f"Mail u{i}@a.test to Zora Pellham, 12 Alder Street, Kestle." for i in range(20_000))
    began = time.time()
    got = mentions(text)
    assert sum(m.kind == "email" for m in got) == sum(m.kind == "address" for m in got) == 20_000
    assert time.time() - began < 60
