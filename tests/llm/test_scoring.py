import random
import re
from collections import Counter

import numpy as np
import pytest

from spanveil.llm import scoring

from .helpers import corpus, documents, empty, rows_of, widened

SMALL = scoring.Scoring(vocabulary=12, width=4, hidden=5, side=2, shard=900, stretch=200, batch=32)


def plain_pieces(word):
    """Pairs of letters or single bytes, spelled out."""
    out, rest = [], word
    while rest:
        letters = re.match(rb"[a-z]{2}", rest)
        own = letters[0] if letters else rest[:1]
        code = (own[0] - 97) * 26 + own[1] - 97 if letters else 26**2 + own[0]
        out.append(code + (26**2 + 256 if out else 0))
        rest = rest[len(own) :]
    return out


def plain_tokens(text, words):
    """Numbers of words, and of the pieces of spelled words."""
    out = []
    for word in scoring.words_of((text or "").encode()):
        out += [words.index(word)] if word in words else [len(words) + p for p in plain_pieces(word)]
    return out


def context_of(ids, i, side, pad):
    return [ids[j] if 0 <= j < len(ids) else pad for j in [*range(i - side, i), *range(i + 1, i + side + 1)]]


def way(tree, token):
    out = []
    for part in (tree.top, tree.below):
        begin = int(part.begin[token])
        out += [(int(part.node[k]), float(part.sign[k])) for k in range(begin, begin + int(part.depth[token]))]
    return out


def log_probability(parts, tree, context, token):
    e, w, b, v = (p.astype(np.float64) for p in parts)
    h = np.tanh(np.concatenate([e[k] for k in context]) @ w + b)
    return -sum(np.log1p(np.exp(-s * (v[n, :-1] @ h + v[n, -1]))) for n, s in way(tree, token))


def plain_gradients(parts, tree, batch):
    """Token by token and decision by decision."""
    e, w, b, v = parts
    found = [np.zeros_like(p) for p in parts]
    width = e.shape[1]
    for context, token in batch:
        x = np.concatenate([e[k] for k in context])
        h = np.tanh(x @ w + b)
        back = np.zeros_like(h)
        for n, s in way(tree, token):
            pull = -s / (1 + np.exp(s * (v[n, :-1] @ h + v[n, -1])))
            found[3][n, :-1] += pull * h
            found[3][n, -1] += pull
            back += pull * v[n, :-1]
        back *= 1 - h * h
        found[1] += np.outer(x, back)
        found[2] += back
        for k, token_beside in enumerate(context):
            found[0][token_beside] += (w @ back)[k * width : (k + 1) * width]
    return found


def plain_training(rows, sizes, numbers, options):
    """Rounds, shards and steps one after the other. rows: turn, shard, place, token numbers."""
    network = scoring.Network(scoring.Tree(numbers), options)
    parts = [p.astype(np.float64) for p in network.parts]
    tables = (0, 3)
    for turn, count in enumerate(sizes):
        ends, changes = [], []
        for shard in range(count):
            own = [p.copy() for p in parts]
            squares = [np.full(len(p) if i in tables else p.shape, 0.1) for i, p in enumerate(own)]
            touched = [np.zeros(len(p), bool) for p in own]
            stream = []
            for _, _, _, ids in sorted((r for r in rows if r[:2] == (turn, shard)), key=lambda r: (r[2], np.array(r[3], np.uint16).tobytes())):
                stream += [(context_of(ids, i, options.side, network.pad), x) for i, x in enumerate(ids)]
            for at in range(0, len(stream), options.stretch):
                stretch = stream[at : at + options.stretch]
                mixed = [stretch[k] for k in np.random.default_rng(options.seed).permutation(len(stretch))]
                for k in range(0, len(mixed), options.batch):
                    batch = mixed[k : k + options.batch]
                    for i, g in enumerate(plain_gradients(own, network.tree, batch)):
                        if i in tables:
                            met = {n for _, t in batch for n, _ in way(network.tree, t)} if i else {x for c, _ in batch for x in c}
                            for r in met:
                                squares[i][r] += (g[r] ** 2).mean()
                                own[i][r] -= options.step * g[r] / np.sqrt(squares[i][r])
                                touched[i][r] = True
                        else:
                            squares[i] += g * g
                            own[i] -= options.step / 10 * g / np.sqrt(squares[i])
            if stream:
                ends.append(own)
                changes.append(touched)
        for i in range(4):
            if i in tables:
                for r in range(len(parts[i])):
                    changed = [e[i][r] for e, c in zip(ends, changes, strict=True) if c[i][r]]
                    if changed:
                        parts[i][r] = np.mean(changed, axis=0)
            elif ends:
                parts[i] = np.mean([e[i] for e in ends], axis=0)
    return parts


def prepared(spark, docs, options):
    counted = scoring.settle(scoring.word_counts(docs.selectExpr("cast(text as binary) as text")))
    words, numbers = scoring.vocabulary(counted, options)
    return words, numbers, scoring.settle(scoring.encoded(docs, words))


def test_tokens_cover_every_text(spark):
    rows = corpus(40)
    words, numbers, coded = prepared(spark, documents(spark, rows), SMALL)
    want = Counter(w for r in rows for w in scoring.words_of((r[1] or "").encode()))
    assert words == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:12]]
    tokens = Counter()
    for r in coded.collect():
        ids = np.frombuffer(r["ids"], np.uint16).tolist()
        assert len(ids) == r["n"]
        tokens.update(ids)
    assert sorted(tokens.elements()) == sorted(x for r in rows for x in plain_tokens(r[1], words))
    assert {k: n for k, n in enumerate(numbers.tolist()) if n} == tokens


def test_probabilities_of_all_tokens_add_up():
    draw = np.random.default_rng(3)
    numbers = draw.integers(0, 50, 40)
    network = scoring.Network(scoring.Tree(numbers), SMALL)
    context = [1, 4, 40, 7]
    first = np.exp([log_probability(network.parts, network.tree, context, t) for t in range(40)])
    assert first == pytest.approx((numbers + 1) / (numbers + 1).sum(), rel=1e-5)  # training begins at the counts
    network.parts[3] += draw.standard_normal(network.parts[3].shape).astype(np.float32)
    assert np.exp([log_probability(network.parts, network.tree, context, t) for t in range(40)]).sum() == pytest.approx(1)


@pytest.mark.parametrize("top", [3, 127])
def test_gradients_of_repeated_tokens_add_up(monkeypatch, top):
    monkeypatch.setattr(scoring, "TOP", top)
    draw = np.random.default_rng(0)
    network = scoring.Network(scoring.Tree(draw.integers(0, 9, 8)), SMALL)
    network.parts = [(p + 0.3 * draw.standard_normal(p.shape)).astype(np.float64) for p in network.parts]
    context, target = draw.integers(0, 3, (20, 4)), draw.integers(0, 8, 20)  # three tokens stand in 80 places

    def loss():
        return -sum(log_probability(network.parts, network.tree, c, t) for c, t in zip(context, target, strict=True))

    found = network.gradients(context, target)
    plain = plain_gradients(network.parts, network.tree, list(zip(context, target, strict=True)))
    for i, g in enumerate(found):
        whole = np.zeros_like(network.parts[i])
        if i in network.TABLES:
            whole[g[0]] = g[1]
        else:
            whole = g
        assert whole == pytest.approx(plain[i], abs=1e-6)
        for _ in range(6):
            at = tuple(draw.integers(n) for n in whole.shape)
            old = network.parts[i][at]
            ends = []
            for step in (1e-5, -1e-5):
                network.parts[i][at] = old + step
                ends.append(loss())
            network.parts[i][at] = old
            assert whole[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-4)


def test_training_and_scores_equal_a_plain_version(spark):
    docs = widened(spark, corpus(40))
    words, numbers, coded = prepared(spark, docs, SMALL)
    dealt, sizes = scoring.dealt(coded, SMALL)
    assert max(sizes) > 1
    rows = [(r["turn"], r["shard"], r["place"], np.frombuffer(r["ids"], np.uint16).tolist()) for r in dealt.collect()]
    assert sum(len(r[3]) for r in rows) == numbers.sum()  # every token trains
    parts = plain_training(rows, sizes, numbers, SMALL)
    network = scoring.train(coded, numbers, SMALL)
    for one, two in zip(network.parts, parts, strict=True):
        assert one == pytest.approx(two, abs=5e-3)
    texts = Counter(r[1] for r in corpus(40))
    got = scoring.score(docs, SMALL).collect()
    by_id = {r[0]: r[1] for r in corpus(40)}
    assert len(got) == sum(texts.values())
    for r in got:
        ids = plain_tokens(by_id[r["doc_id"]], words)
        assert r["n_words"] == len(scoring.words_of((by_id[r["doc_id"]] or "").encode()))
        want = sum(log_probability(network.parts, network.tree, context_of(ids, i, SMALL.side, network.pad), x) for i, x in enumerate(ids))
        assert r["log_likelihood"] == pytest.approx(want, abs=1e-3 * (1 + len(ids)))
        assert (r["mean_log_likelihood"] is None) == (r["n_words"] == 0)


def test_partitions_and_the_order_of_rows_do_not_matter(spark):
    draw = random.Random(3)
    rows = corpus(40) + [(500, " ".join(draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(9000)), "en", "s", 1)]
    docs = documents(spark, rows)
    first = rows_of(scoring.score(docs.coalesce(1), SMALL))
    assert rows_of(scoring.score(docs.repartition(8, "doc_id").orderBy("n_chars"), SMALL)) == first
    assert rows_of(scoring.score(documents(spark, rows[::-1]).repartition(3), SMALL)) == first


def test_both_sides_help_and_shuffled_texts_score_lower(spark):
    draw = random.Random(3)
    grammar = ["the big dog sees a small cat", "a red car stops near the old house", "we read the long book at home"]
    rows = [(i, " ".join(draw.choice(grammar) for _ in range(8)), "en", "s", 1) for i in range(300)]
    shuffled = []
    for i in range(30):
        words = rows[i][1].split()
        draw.shuffle(words)
        shuffled.append((1000 + i, " ".join(words), "en", "s", 1))
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in scoring.score(documents(spark, rows + shuffled), scoring.Scoring(batch=64)).collect()}
    good, bad = np.mean([got[r[0]] for r in rows]), np.mean([got[r[0]] for r in shuffled])
    uniform = -np.log(len({w for g in grammar for w in g.split()}))
    assert good > bad + 1 and good > uniform + 1


def test_odd_tables_and_reruns(spark):
    assert scoring.score(empty(spark)).count() == 0
    nothing = documents(spark, [(1, None, None, None, None), (1, "", None, None, 0), (None, "?!", None, None, 2)])
    assert {tuple(r)[1:4] for r in scoring.score(nothing).collect()} == {(0, 0.0, None)}
    docs = documents(spark, corpus(30)).coalesce(2)
    assert rows_of(scoring.score(docs, SMALL)) == rows_of(scoring.score(docs, SMALL))


def test_words_are_coded_by_columns():
    draw = random.Random(2)
    words = [b"q", *(bytes(draw.choice(b"abz0\xc3\xa4{`") for _ in range(draw.randint(1, 9))) for _ in range(300))]
    found, size = scoring.spelled(scoring.pa.array(words, "binary")[1:])
    want = [plain_pieces(w) for w in words[1:]]
    assert found.tolist() == [p for x in want for p in x] and size.tolist() == [len(x) for x in want]
    assert [len(x) for x in scoring.spelled(scoring.pa.array([], "binary"))] == [0, 0]
    texts = ["", " A b", None, "ab  ab?c", "!"]
    distinct, at, counts = scoring.words_in(scoring.pa.array([t and t.encode() for t in texts], "binary"))
    assert [distinct[k].as_py() for k in at.tolist()] == [b"a", b"b", b"ab", b"ab", b"c"] and counts.tolist() == [0, 2, 0, 3, 0]


def test_scores_are_finite_and_do_not_depend_on_the_texts_beside():
    draw = np.random.default_rng(5)
    network = scoring.Network(scoring.Tree(draw.integers(0, 50, 300)), SMALL)
    network.parts = [(p + draw.standard_normal(p.shape)).astype(np.float32) for p in network.parts]
    texts = [draw.integers(0, 300, n).astype(np.int32) for n in (1, 3000, 7, 500)]
    scorer = scoring.Scorer(network)
    assert [scorer.log_probabilities([t])[0] for t in texts] == scorer.log_probabilities(texts)
    network.parts[3][:, -1] = 200  # exp(200) is too large for four bytes
    for text, got in zip(texts, scoring.Scorer(network).log_probabilities(texts), strict=True):
        want = sum(s < 0 and 200 for t in text.tolist() for _, s in way(network.tree, t))
        assert got == pytest.approx(-want, rel=0.05, abs=1)


def test_shards_are_averaged_by_blocks():
    draw = np.random.default_rng(4)
    values, shards = draw.integers(-(1 << 40), 1 << 40, (3, 5)), np.array([[1, 0, 2, 1, 0], [1, 1, 0, 3, 0], [1, 0, 0, 1, 0]], np.int32)
    rows = [scoring.pa.record_batch({"block": scoring.pa.array([8], "int32"), "value": [v.tobytes()], "shards": [s.tobytes()]}) for v, s in zip(values, shards, strict=True)]
    (got,) = scoring.averaged(iter(rows))
    found = np.frombuffer(got.column("value")[0].as_py())
    assert got.column("block").to_pylist() == [8] and np.isnan(found[4])
    assert found[:4] == pytest.approx(values.sum(axis=0)[:4] / shards.sum(axis=0)[:4] / scoring.UNIT)
