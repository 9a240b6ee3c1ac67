"""Cases in which an operator once did less than its whole job."""

import hashlib
import itertools
import re
import time

import duckdb
import numpy as np
import pytest
from conftest import SMALL

from oxbow.llm import chat, decontaminate, html, pii, simhash, toxicity

ENGLISH = "There is a story that was told of the old man and the sea, and it was the best that he had for all of them that are in the town. " * 2
FINNISH = "Vanha kalastaja kertoi kylän lapsille tarinan merestä, jossa suuret kalat uivat syvällä ja myrskyt kaatoivat veneitä joka syksy. " * 2


def test_article_is_a_feature_not_a_verdict():
    body = f"<div>{ENGLISH}</div><div>He said so.</div><div>{ENGLISH}</div>"
    page = f"<body><nav><a href=1>Home</a></nav><article><h3>Next week</h3><p>Another story</p></article>{body}<footer>me</footer></body>"
    assert html.main_text(page).split("\n")[-3:] == [ENGLISH.strip(), "He said so.", ENGLISH.strip()]
    listed = f"<article><p>{ENGLISH}</p><div class=related><h3>Related</h3><ul><li><a href=1>One thing</a><li><a href=2>Another thing</a></ul></div><p>The end.</p></article>"
    assert html.main_text(listed) == f"{ENGLISH.strip()}\nThe end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Intro</p><ul><li><a>Chapter one</a></li></ul></article>", "Intro\nChapter one"),
        ("<article><p>Abc def <a>&eacute;&eacute;&eacute;</a></p></article>", "Abc def ééé"),
        ("<article><p>Main</p></article><article class=comment><p>Reader</p></article>", "Main"),
        ("<article><p>Hello <b hidden>x</b>me <em style='display:none'>y</em> end</p></article>", "Hello me end"),
        ("<article><p data-x=it's>Hello it's me</p></article>", "Hello it's me"),
        ('<article><p class="x>Hello</p></article>', "Hello"),
        ("<article><p class=notice-period>A month.</p><p class=cookie-notice>We use cookies</p></article>", "A month."),
        ("<article><p>One <span class=ad>Buy</span> two</p></article>", "One two"),
        ("<article><p>a<br><br>b<br>c</p></article>", "a\nb c"),
    ],
)
def test_nothing_else_of_the_article_is_dropped(page, text):
    assert html.main_text(page) == text


def test_links_around_blocks_are_links():
    linked = f"<a href=1><div>{ENGLISH}</div></a>"
    assert html.main_text(f"<body><div>{ENGLISH}</div>{linked}<div>{ENGLISH}</div></body>") == f"{ENGLISH.strip()}\n{ENGLISH.strip()}"


@pytest.mark.parametrize("part", ["<p class=\"x", "<", "<a ", "<p x='", "<b hidden>", "<span>", "<div>", "<p x= ", "&", "<!--", "word "])
def test_long_pages_take_linear_time(part):
    began = time.process_time()
    html.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 30


def test_unlisted_languages_need_no_stop_words():
    page = f"<body><div><a href=1>Koti</a></div><div>{FINNISH}</div><div>Niin se oli.</div><div>{FINNISH}</div><div><a href=2>Muut sivut</a></div></body>"
    assert html.main_text(page) == f"{FINNISH.strip()}\nNiin se oli.\n{FINNISH.strip()}"
    beside = f"<body><article><p>Kortti</p></article><div>{FINNISH}</div></body>"
    assert FINNISH.strip() in html.main_text(beside)


def brute_leaks(text, items):
    """As leaks(), over all windows of min(size of the item, words of the text) words."""
    w, out = decontaminate.words_of(text), []
    for i, (_, x) in enumerate(items):
        iw = decontaminate.words_of(x)
        size = min(len(iw), len(w))
        found = [(decontaminate.similarity(decontaminate.shingles(w[k : k + size]), decontaminate.shingles(iw)), -k) for k in range(len(w) - size + 1)] if size else []
        if found and max(found)[0] >= decontaminate.SIMILARITY:
            out.append((i, -max(found)[1], size, max(found)[0]))
    return out


@pytest.mark.parametrize("words", [5, 9, 10, 50])
def test_documents_shorter_than_an_item(words):
    items = [(1, " ".join(f"w{k}" for k in range(words))), (2, " ".join(["again and"] * words)), (3, "w0 w1"), (4, " ".join(f"w{k}" for k in range(3 * words)))]
    index = decontaminate.Index(items)
    for less in range(words):
        for lo in (0, less // 2, less):
            for _, x in items:
                w = x.split()
                text = " ".join(w[lo : len(w) - (less - lo)])
                assert index.leaks(text) == brute_leaks(text, items)
    assert [x[0] for x in index.leaks(" ".join(f"w{k}" for k in range(words - 1)))] == ([0, 2] if words >= 9 else [2])


def test_shortened_items_leak(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(k, b" ".join(decontaminate.words_of(t)[lo : -hi or None]).decode()) for k, (_, t) in enumerate(items) for lo, hi in ((1, 0), (0, 2), (2, 1), (0, 9))]
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.similarity) for r in decontaminate.leaks(df, table).collect())
    want = [[(items[i][0], *x) for i, *x in brute_leaks(t, items)] for _, t in docs]
    assert got == sorted((d, *x) for (d, _), found in zip(docs, want, strict=True) for x in found)
    assert decontaminate.clean(df, table).count() == sum(not x for x in want) < len(docs)


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = np.array([int(p) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 14), replace=False)) for p in rng.choice(prints, 4000)], np.uint64)
    a, b = decontaminate.Table(prints).near(fps)
    want = np.argwhere(np.bitwise_count(fps[:, None] ^ prints[None, :]) <= decontaminate.RADIUS)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
    spread = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    passed = np.mean([known[v] for (known, *_), v in zip(decontaminate.Table(prints[:1]).blocks, spread.view(np.uint16).reshape(-1, 4).T, strict=True)])
    assert passed < 0.003  # of a block's values one stretch is entered for


def test_recall_of_leaks_near_the_threshold():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 8))) for _ in range(600)]
    items = [(n, " ".join(rng.choice(words, rng.integers(12, 160)))) for n in range(60)]
    index, found, wanted = decontaminate.Index(items), 0, 0
    for _, text in items:
        for _ in range(5):
            w, kind = text.split(), rng.integers(0, 4)
            for _ in range(rng.integers(0, 1 + len(w) // 45) if kind == 0 else 1):
                at = int(rng.integers(0, len(w)))
                w = [*w[:at], "zzz", *w[at + 1 :]] if kind == 0 else [*w[:at], "yyy", *w[at:]] if kind == 1 else w[len(w) // 12 :] if kind == 2 else w[: -(len(w) // 12) or None]
            doc = " ".join([*rng.choice(words, 30), *w, *rng.choice(words, 30)])
            want = {i for i, *_ in brute_leaks(doc, [(0, text)])}
            wanted += len(want)
            found += bool(want) and text in {items[i][1] for i, *_ in index.leaks(doc)}
    assert wanted > 150 and found >= 0.99 * wanted


def test_labels_reach_every_occurrence_of_a_key():
    # a field in which twelve digits alone are no entity
    orders = [f"order {10**11 + 7919 * k * k} and {10**11 + 104729 * k} of box" + f" code {10**11 + 31 * k}" * (8 * (k % 3 == 0)) + f" call +4917012{k:05d} or +4917012{k:05d}" for k in range(300)]
    field = pii.Field(orders)
    for n in (3, 12, 40, 1000):
        later = " and ".join(["491701234567"] * n)
        for text in (f"call +491701234567 and {later}", f"{later} and +491701234567 now"):
            base, spans = field.spans(text)
            assert (len(base), len(spans)) == (1, n + 1)
            assert "4917" not in pii._hidden(field, text)
    assert field.spans("order 491701234567 and 491701234567") == ([], [])


def test_many_occurrences_do_not_outvote_an_observed_one():
    text = "+491701234567 " + "x 491701234567 y " * 2000
    field = pii.Field([])
    nodes = pii.Nodes(text, pii.base_spans(text))
    assert field.beliefs(nodes, nodes.hops())[0].argmax() == 1 + pii.KINDS.index("phone")
    assert nodes.hops().tolist() == [0] + [1] * 2000


def test_a_passage_counts_wherever_it_starts():
    told = np.zeros(toxicity.BUCKETS)
    bad = [f"zq{chr(97 + k)}xw" for k in range(20)] * 2
    told[toxicity.grams_of(" ".join(bad))[0]] = 2.0
    scorer = toxicity.Scorer(told, -1.0, None)
    clean = [f"{chr(97 + k % 20)}bcd" for k in range(200)]
    whole = scorer.score(" ".join(bad))
    assert whole > 0.7
    for start in range(50):
        assert scorer.score(" ".join([*clean[:start], *bad, *clean[start:]])) == pytest.approx(whole)
        marks = np.r_[np.zeros(start), np.ones(toxicity.PASSAGE), np.zeros(90)]
        assert toxicity._worst(marks) == start


VARIANTS = {
    "phone": [lambda x: x.lstrip("+"), lambda x: re.sub("[^0-9]", "", x), lambda x: ".".join(re.findall("[0-9]+", x)), lambda x: re.sub("[^0-9]", "", x)[-10:]],
    "email": [lambda x: x.replace("@", " [at] ").replace(".", "[dot]"), lambda x: x.upper().replace("@", " at "), lambda x: x.partition("@")[0].title()],
    "ip": [lambda x: x.replace(".", "[.]"), lambda x: x.replace(".", "-"), lambda x: x.replace(".", " . ")],
    "card": [lambda x: ".".join(re.findall("....", x)), lambda x: "  ".join(re.findall("....", x))],
}


def test_the_field_finds_planted_variants_and_nothing_else():
    docs = [r[0] or "" for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    field, rng = pii.Field(docs), np.random.default_rng(8)
    planted = found = wrong = decoys = 0
    for text in docs:
        for a, k, b in pii.base_spans(text):
            mention = text[a:b]
            for vary in VARIANTS[pii.KINDS[k]]:
                other, decoy = vary(mention), "".join(map(str, rng.integers(1, 10, 11)))
                new = f"{text} {decoy} thereupon, {other}, as {decoy} said"
                if len(mention) < 7 or any(x < len(new) - len(f"{other}, as {decoy} said") + len(other) and len(text) < y for x, _, y in pii.base_spans(new)):
                    continue  # the patterns find it, or it makes a longer number
                base, spans = field.spans(new)
                at = len(text) + len(f" {decoy} thereupon, ")
                planted, decoys = planted + 1, decoys + 2
                found += any(x <= at and at + len(other) <= y and kind == k for x, kind, y in spans)
                wrong += sum(x >= len(text) and not (x < at + len(other) and at < y) for x, _, y in spans)
    assert planted > 100 and decoys > 200
    assert found >= 0.95 * planted and wrong == 0, (found, planted, wrong)


class Line:
    """Four nodes whose edges make a tree."""

    def __init__(self, rng):
        self.x, self.label, self.inside = rng.normal(size=(4, pii._FEATURES)), np.array([0, 4, 0, 0]), np.array([False, True, False, False])
        self.next, self.skip, self.far = [(0, 1)], [(1, 3)], [(0, 2)]

    def features(self):
        return self.x


def test_messages_give_the_exact_marginals_of_a_tree():
    field, nodes, labels = pii.Field(["call +49 170 1234567 or 491701234567, mail a.b@c.de"] * 3), Line(np.random.default_rng(3)), range(len(pii.KINDS) + 1)
    unary = nodes.x @ field.weights
    want = np.zeros((4, len(labels)))
    for y in itertools.product(labels, repeat=4):
        if y[1] == 4:
            p = np.exp(sum(unary[i, y[i]] for i in (0, 2, 3)) + field.step[y[0], y[1]] + field.skip[y[1], y[3]] + field.skip[y[0], y[2]])
            for i in range(4):
                want[i, y[i]] += p
    got = field.beliefs(nodes, np.array([-1, 0, -1, 1]))
    assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 0.01


@pytest.mark.parametrize("run", ["x" * 10**6, "1" * 10**6, "1." * 300_000, "@" * 200_000, "a.b@" * 100_000, "(1" * 200_000, "+1" + " " * 10**6, "漢字" * 300_000])
def test_long_unbroken_texts_take_linear_time(run):
    began = time.process_time()
    assert pii.Field([]).spans(f"a.b1@c.de {run}")[0][0] == (0, 0, 9)
    assert time.process_time() - began < 30


def test_typed_conversations(spark):
    parts = '[{"type": "text", "text": "see <|end|> "}, {"type": "image", "ref": "i.png", "width": 600, "height": 400}, {"type": "document", "ref": "d.pdf", "pages": 3}]'
    turns = spark.createDataFrame([(1, 1, "assistant", "fine"), (1, 0, "user", parts), (2, 0, "user", '[{"type": "audio", "ref": "a.wav", "seconds": 2}]')], "conv_id long, turn long, role string, text string")
    segments = chat.conversations(turns, typed=True)
    attached = {1: [], 2: []}
    for r in segments.orderBy("conv_id", "part", "nth").collect():
        attached[r.conv_id] += [tuple(x) for x in r.attachments]
    assert attached == {1: [("image", "i.png", 425), ("document", "d.pdf", 2400)], 2: [("audio", "a.wav", 50)]}
    told = {r.conv_id: (r.n_turns, r.n_attachments, r.n_tokens, r.loss_chars) for r in chat.read_back(segments).collect()}
    assert told == {1: (2, 2, 6 + 425 + 2400 + 1, 4), 2: (1, 1, 50, 0)}
    assert {(r.conv_id, r.n_attachments) for r in chat.read_back(chat.conversations(turns)).collect()} == {(1, 0), (2, 0)}


def test_one_long_conversation_is_split_and_read_in_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 500)
    rows = [(7, k, ("user", "assistant")[k % 2], f"text {k} <|end|> " * (k % 5)) for k in range(400)]
    (got,) = chat.read_back(chat.conversations(spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string").repartition(6))).collect()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_a_tree_keys_children_by_their_distance():
    fps = np.unique(np.random.default_rng(4).integers(0, 1 << 20, 500).astype(np.uint64))
    tree = simhash.Tree(fps)
    assert sorted(tree.members[tree.root].tolist()) == list(range(len(fps)))
    for node, edges in tree.edges.items():
        assert sorted(x for c in edges.values() for x in tree.members[c].tolist()) == sorted(tree.members[node][1:].tolist())
        assert all((tree.distance(tree.members[c], node) == k).all() for k, c in edges.items())


def test_models_of_texts_without_words():
    for texts in (["", ""], ["", "a b c"], ["!!", "?"]):
        assert 0 <= toxicity.Model().fit(texts, [0, 1]).scorer().score("") <= 1
    assert toxicity._best_cut(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])) == 1.5


def test_training_reads_whole_texts(spark):
    docs = spark.createDataFrame([(k, "word " * 30_000 + ("zzxq zzxqs" if k % 2 else "end")) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    scorer = toxicity.train(docs, labels).scorer()
    assert scorer.score("zzxq zzxqs") > scorer.score("end word")
