"""Methods against brute force, round trips and held-out accuracy, without a session."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import bpe, langid, neardup, packing, quality, rules, spans, tokenize, toxicity


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    path = tokenize.public_vocabulary()
    return bpe.Encoder(bpe.SegmentTreeBpe(path), memo=50), bpe.Encoder(bpe.LibraryBpe(path)), Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=6))
def test_encoders_equal_the_library(pair, texts):
    own, by_library, t = pair
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in by_library.encode(texts)] == want
    assert [own.decode(x) for x in own.encode(texts)] == [t.decode(i, skip_special_tokens=False) for i in want]


@pytest.mark.parametrize("backend", [bpe.SegmentTreeBpe, bpe.LibraryBpe])
def test_each_word_is_merged_once(backend, monkeypatch):
    """Case, stops and a text's place change nothing about a word, also in later steps."""
    enc, asked = bpe.Encoder(backend(tokenize.public_vocabulary()), step_chars=20), []
    enc._backend._stops  # merged once and for all
    merge = enc._backend.encode_words
    monkeypatch.setattr(enc._backend, "encode_words", lambda words: asked.extend(words) or merge(words))
    list(enc.encode(["Wort wort WORT wort. Wort, x wort!", "wort? Wort: y ÜBER", "über; Über wort"]))
    assert sorted(asked) == ["wort", "x", "y", "über"]


def test_special_tokens_and_white_space(pair):
    own, by_library, t = pair
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "</w>", "a</w>", "...", ".", "it's.", "5.", "é.", "\x1c", "\x1fa"]
    white = [" ", "", "\n", "\x0b", "\x85", "\xa0", "\u1680", "\u2000", "\u2028", "\u202f", "\u3000"]
    texts = ["", " ", "\t\n", *(a + w + b for a in marks for w in white for b in marks), "A\u030a ΣΑΣ. ÍI\u0307" * 3, None]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for enc in (own, by_library):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
        assert [np.frombuffer(next(enc.encode([x])), "<u4").tolist() for x in texts] == want


def test_library_words_without_marked_ends():
    """Where ids do not tell the ends of words, the library does."""
    lib, words = bpe.LibraryBpe(tokenize.public_vocabulary()), ["one", "unquestionably", "x", "größe", "</w>"] * 70
    want = lib.encode_words(words)
    assert lib._final is not None and want == bpe.SegmentTreeBpe(tokenize.public_vocabulary()).encode_words(words)
    lib._final = None
    assert lib.encode_words(words) == want


@pytest.mark.parametrize("word", ["a" * 5000, "in" * 300, "é" * 70, "ab" * 32, "ab" * 33])
def test_long_words(pair, word):
    own, _, t = pair
    assert np.frombuffer(next(own.encode([word])), "<u4").tolist() == t.encode(word, add_special_tokens=False).ids


def test_shingles_and_links():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(120)]
    for edits in range(12):
        other = list(base)
        for _ in range(edits):
            other[draw.randrange(120)] = "x"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        x, y = neardup.shingles(" ".join(base)), neardup.shingles("\t".join(other).replace("w", "W"))
        assert (len(x), len(y)) == (len(a), len(b))
        assert neardup.linked(x, y) == (100 * len(a & b) >= 75 * len(a | b))
    assert len(neardup.shingles(None)) == len(neardup.shingles(" \n")) == 0 and len(neardup.shingles("a b")) == 1


def test_children_keep_similar_classes_together():
    of = neardup.minwise()
    a = np.arange(1, 400, dtype=np.uint64)
    tokens = np.stack([of.tokens(neardup._mix(a)), of.tokens(neardup._mix(a[:-20]))])
    roots = of.root_nodes(tokens)
    assert (roots[0] == roots[1]).sum() >= 6
    for rows, child in of.children(roots[:, 0].copy(), tokens):
        assert len(rows) == len(child)


def test_pairs_share_a_node_at_the_deepest_level():
    of, draw, lost = neardup.minwise(), np.random.default_rng(5), 0
    for _ in range(1500):  # pairs of similarity 0.75
        a = draw.integers(1, 2**63, 400, np.uint64)
        tokens = np.stack([of.tokens(a[:350]), of.tokens(a[50:])])
        roots = of.root_nodes(tokens)
        shared = set(roots[0][roots[0] == roots[1]].tolist())
        for _ in range(neardup.DEPTH):
            nodes = np.array(sorted(shared), np.int64)
            left, right = ({c for _, child in of.children(nodes, np.repeat(t[None], len(nodes), 0)) for c in child.tolist()} for t in tokens)
            shared = left & right
        lost += not shared
    assert lost == 0


@pytest.mark.parametrize("small, rest, depth", [(4096, 256, 4), (8, 0, 4), (8, 0, 1), (8, 0, 0), (2, 300, 4)])
def test_planted_pairs_of_a_family_by_brute_force(spark, monkeypatch, small, rest, depth):
    """All small; branched to the last level; pairs of blocks after one level and at once; nodes led by one component."""
    from keystrata.llm.storage import Scratch

    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "REST", rest)
    monkeypatch.setattr(neardup, "DEPTH", depth)
    draw, texts = random.Random(12), []
    template = [f"t{k}" for k in range(60)]
    for k in range(120):
        own = template + [f"x{k}y{j}" for j in range(50)]  # no two of one family are linked
        texts.append(own)
        if k % 2 == 0:  # 106 shingles, of which a pair shares about six in seven
            at = draw.randrange(64, 100)
            texts.append(own[:at] + [f"z{k}w{j}" for j in range(8)] + own[at + 8 :])
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [neardup.shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if neardup.linked(sets[i], sets[j]):
                p, q = sorted((find(i), find(j)))
                top[q] = p
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: find(k) for k in range(len(docs))}
    assert len({find(k) for k in range(len(docs))}) == 120


def test_pieces_tile_the_text():
    draw = random.Random(9)
    for _ in range(300):
        text = "".join(draw.choice(["a b. ", "c!", "。", "d，", " \n ", "h\n", "\n\n", "i, ", "  ", "j:k"]) for _ in range(draw.randrange(14)))
        assert "".join(spans.sentences(text)) == text


def test_spans_by_brute_force(spark):
    from keystrata.llm.storage import Scratch

    draw = random.Random(10)
    for _ in range(2):
        pool = [" ".join(draw.choice("abcdefg") for _ in range(draw.randrange(1, 5))) + draw.choice([".", "!", ",", ";", ""]) for _ in range(12)]
        docs = {}
        for k in range(80):
            docs[k] = "".join(draw.choice(pool) + draw.choice([" ", " ", "\n", " \n ", "\n\n", "  "]) for _ in range(draw.randrange(14)))
        rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
        got = {r.doc_id: r.text.split() for r in spans.without_repeats(rows, Scratch(spark, "t"), words=6).collect()}
        assert got == brute.without_repeats(docs, 6)


PASSAGE = "The quick brown fox jumps over it. Nobody had seen such a thing in all these years. They told it to each other again and again that winter."


def left(spark, *texts):
    from keystrata.llm.storage import Scratch

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in spans.without_repeats(rows, Scratch(spark, "t")).orderBy("doc_id").collect()]


def test_passages_go_from_later_documents_only(spark):
    first, later, other = left(spark, f"Before it. {PASSAGE} After it.", f"Something else here {PASSAGE} And more.", "Nothing of that. At all.")
    assert first == f"Before it. {PASSAGE} After it." and other == "Nothing of that. At all."
    assert later == "Something else here The quick brown fox jumps over it. And more."


def test_rewrapped_passages_are_found(spark):
    words = PASSAGE.split()
    wrapped = "\n".join(" ".join(words[a : a + 7]) for a in range(0, len(words), 7))
    assert left(spark, f"One. {PASSAGE} End of it.", f"Two. {wrapped} Something else.")[1] == "Two. Something else."
    assert left(spark, f"One. {wrapped} End of it.", f"Two. {PASSAGE} Something else.")[1] == "Two. Something else."


def test_passages_without_spaces_are_found(spark):
    passage = "今天天气很好我们去公园。孩子们在草地上跑来跑去非常高兴。晚上大家一起吃饭讲故事直到很晚。"
    assert left(spark, f"开始。{passage}结束了。", f"另外的话。{passage}别的内容。")[1] == "另外的话。别的内容。"


def test_one_long_sentence_alone_is_no_run(spark):
    long = " ".join(f"w{k}" for k in range(60)) + "."
    assert left(spark, f"A b. {long} C d.", f"E f. {long} G h.")[1] == f"E f. {long} G h."


def test_packing_is_close_to_the_bound():
    draw = np.random.default_rng(2)
    lengths = np.clip(draw.lognormal(6.3, 0.9, 6000).astype(int), 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.configurations(counts)
    used = Counter()
    for contents, copies in plan:
        assert sum(n * k for n, k in contents.items()) <= 4096
        for n, k in contents.items():
            used[n] += k * copies
    assert used == {n: c for n, c in enumerate(counts) if c}
    bound = -(-int(lengths.sum()) // 4096)
    assert bound <= sum(c for _, c in plan) <= 1.005 * bound + 2
    assert packing.configurations(np.zeros(4097, int)) == []


def test_knapsack_is_best():
    draw = random.Random(5)
    for _ in range(20):
        prices = np.zeros(31)
        for _ in range(4):
            prices[draw.randint(2, 12)] = draw.random()
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(prices[n] + best[c - n] for n in range(1, c + 1) if prices[n])])
        value, choice = packing.knapsack(prices, 30)
        assert np.allclose(value, best)


def test_expectation_maximisation_keeps_single_failures_apart():
    draw = random.Random(3)
    patterns = Counter()
    for _ in range(2000):
        bad = draw.random() < 0.2
        votes = [rules.GOOD] * 4
        if bad:
            votes[draw.randrange(3)] = rules.BAD
        elif draw.random() < 0.05:
            votes[3] = rules.NONE
        patterns[tuple(votes)] += 1
    shares, rates = rules.expectation_maximisation(dict(patterns))
    assert 0.75 < shares[0] < 0.85
    assert all(rates[0][r][rules.BAD] < 0.01 and rates[1 + r][r][rules.BAD] > 0.9 for r in range(3))


def test_sparse_rules_learn_a_conjunction():
    draw = np.random.default_rng(1)
    x = draw.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    found, weights, intercept = quality.fit(x[:2000], y[:2000])
    odds = quality._holds(found, x[2000:]) @ weights + intercept
    assert ((odds > 0) == y[2000:]).mean() > 0.95
    assert 0 < (weights != 0).sum() < len(found) / 2


def test_language_centroids():
    draw = random.Random(2)
    parts = {"aa": ["ka", "ro", "mi", "ten"], "bb": ["schu", "berg", "ein", "heit"]}
    make = lambda k: " ".join("".join(draw.choice(parts[k]) for _ in range(3)) for _ in range(30))
    rows = []
    for k in parts:
        for _ in range(40):
            c, n = np.unique(langid.trigrams(make(k)), return_counts=True)
            rows.append((k, c, n))
    model = langid.Centroids(rows)
    assert all(model.predict(make(k))[0] == k for k in parts for _ in range(20))
    assert model.predict("xyzzy qwq vlv")[2] and model.predict("123 !!") == ("und", 0.0, True)


def test_gradients_of_the_network():
    net = toxicity.Network(1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    features = toxicity.word_features(["abc", "hello", "x."])
    ids, y = np.array([[0, 1, 2, -1], [2, 1, -1, -1]]), np.array([1.0, 0.0])
    inside = np.array([[0, 1, 1, 1], [1, 1, 1, 1]], bool)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.inputs(features).astype(float), ids, inside)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = net.gradients(features, ids, y, inside=inside)
    for name, at in (("rec", (0, 1, 3)), ("rec", (1, 2, 17)), ("inw", (3, 20)), ("att", (3,)), ("out", (9,)), ("bias", (0,)), ("word", (features[0][1], 2)), ("char", (features[1][2], 4))):
        value = net.p[name]
        old, step = value[at], 1e-3
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-5, name


def test_each_window_lies_in_one_segment():
    count = np.array([0, 1, 47, 48, 49, 192, 193, 337, 338, 5000])
    owner, first, length = toxicity.segments(count)
    for k, n in enumerate(count):
        own = [(a, m) for o, a, m in zip(owner, first, length) if o == k]
        starts = [a + i for a, m in own for i in range(max(1, m - 47))]
        assert starts == list(range(max(1, n - 47)))
        assert all(a + m <= n and m <= 192 for a, m in own)


def test_scores_equal_the_network():
    net, draw = toxicity.Network(3), random.Random(5)
    texts = [" ".join(f"w{draw.randrange(90)}" for _ in range(n)) for n in (0, 1, 30, 47, 48, 49, 130, 192, 400)] + [None, "x" * 95 + " y"]
    words, places, count = toxicity.numbered(texts)
    x = net.inputs(toxicity.word_features(words))
    assert [words[p] for p in places] == [w for t in texts for w in toxicity.words_of(t)]
    begin = np.cumsum(count) - count
    best, start = net.worst(x, places, count)
    for k, score in enumerate(net.scores(texts)):
        found = []
        for owner, first, length in zip(*toxicity.segments(count[k : k + 1])):
            ids = places[begin[k] + first : begin[k] + first + length][None]
            for a in range(max(1, length - 47)):
                inside = (np.arange(length) >= a) & (np.arange(length) < a + 48)
                found.append(float(net.forward(x, ids, inside[None])[0]) if length else float(net.p["bias"][0]))
        assert abs(max(found) - np.log(score / (1 - score))) < 1e-4 and abs(best[k] - max(found)) < 1e-4
        assert abs(found[start[k]] - max(found)) < 1e-4


def test_a_toxic_passage_counts_wherever_it_begins():
    draw = random.Random(6)
    clean = [f"w{i}" for i in range(400)]
    make = lambda n: [draw.choice(clean) for _ in range(n)]
    passage = lambda: [w for _ in range(4) for w in (draw.choice(["badword", "vileness"]), draw.choice(clean))]
    texts, labels = [], []
    for k in range(240):
        words = make(150)
        if k % 3 == 0:
            at = draw.randrange(150)
            words[at:at] = passage()
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    net = toxicity.fit(texts, np.array(labels))
    words = make(400)
    assert net.scores([" ".join(words)])[0] < 0.5
    assert all(s >= 0.5 for s in net.scores([" ".join([*words[:at], *passage(), *words[at:]]) for at in range(0, 401)]))


def test_network_learns_telling_words():
    draw = random.Random(6)
    clean = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for k in range(240):
        words = [draw.choice(clean) for _ in range(60)]
        if k % 3 == 0:
            for _ in range(4):
                words[draw.randrange(60)] = draw.choice(["badword", "vileness" + draw.choice("abcdef")])
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    net = toxicity.fit(texts[:180], np.array(labels[:180]))
    got = np.array(net.scores(texts[180:])) >= 0.5
    assert (got == (np.array(labels[180:]) == 1)).mean() > 0.9


def test_texts_without_white_space_are_read_to_the_end():
    draw = random.Random(6)
    clean = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for k in range(240):
        words = [draw.choice(clean) for _ in range(150)]
        if k % 3 == 0:
            for _ in range(4):
                words[draw.randrange(90, 150)] = draw.choice(["badword", "vileness" + draw.choice("abcdef")])
        texts.append(",".join(words))
        labels.append(int(k % 3 == 0))
    net = toxicity.fit(texts[:180], np.array(labels[:180]))
    got = np.array(net.scores(texts[180:])) >= 0.5
    assert (got == (np.array(labels[180:]) == 1)).mean() > 0.9
    signs = "".join(chr(0x4E00 + 7 * draw.randrange(300)) for _ in range(1000))
    x = [net.inputs(toxicity.word_features(toxicity.words_of(t))) for t in (signs, signs[:-7] + "恶毒词语" + signs[-3:])]
    assert len(x[0]) == len(x[1]) > 100 and (x[0][-2:] != x[1][-2:]).any() and (x[0][:-2] == x[1][:-2]).all()


def test_long_words_lose_no_character():
    for word in ("a" * 40, "ab" * 21, "語" * 13, "語" * 14, "😀" * 500, "x" * 5000 + "end", "İ" * 25, "((((" * 30):
        pieces = toxicity.words_of(f"one {word} two")
        assert pieces[0] == "one" and pieces[-1] == "two"
        own = pieces[1:-1]
        whole = own[0] + "".join(p[toxicity.SHARED :] for p in own[1:])
        assert whole == (word if len(own) == 1 else word.lower())
        assert all(len(p.strip(toxicity._AROUND).encode()) <= 40 for p in own)
    assert toxicity.word_features(["a" * 39 + "b"])[0] != toxicity.word_features(["a" * 39 + "c"])[0]


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_by_brute_force(spark):
    from keystrata.llm.storage import Scratch

    draw = random.Random(8)
    texts = [None, "", "a b\n\nc d\n\ne f", "x y\n \t\n\nx y\n \t\nq", "\x1c\n\x1c", "a|b <c>\r\n" * 30, "wort " * 40_000, "ab\u3000c\xa0d \u2028e\n" * 9]
    for k in range(80):
        words = [draw.choice("abcdefgh") for _ in range(draw.randrange(60))]
        if k % 2:
            words += words[: draw.randrange(1, 12)] * 2
        texts.append("".join(w + draw.choice([" ", "\n", "\t ", "\n\n", "\n \t\n", "# "]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rules.quality_by_rules(docs, Scratch(spark, "t")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base_counts(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)
