"""The operators that run numpy over Arrow batches, against brute force, round trips and held-out labels."""

import itertools
import random
import sys
import types
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import Row
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, learning, near_join, packing, quality, queries, token_counts, toxicity
from larkspur.llm.tokens import encoder, vocabulary_path

from .odd import TEXTS, count, jaccard, no_documents, odd_documents, shingles_of, small, texts

PIECES = [" ", "  ", "\n", "\t", " \n", "a", "B", "é", "'s", "12", "!!", " the", "ing", "\x1c", "😀", ".", "<|endoftext|>", "x y", "　", "中文", "\r\n"]


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores))
    ones = labels == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


def plain_ids(text):
    return encoder(vocabulary_path()).tokenizer.encode(text, add_special_tokens=False).ids


def random_text(rnd, most):
    return "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, most)))


# tokens and counts


def test_ids_like_the_tokenizer():
    rnd, e = random.Random(4), encoder(vocabulary_path())
    values = ["", None, *(random_text(rnd, 40) for _ in range(1500)), "a" * 20_000, " " * 20_000, "ab " * 5_000 + "\n" * 900]
    for text, ids in zip(values, e.ids(values), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain_ids(text or "")
        chars, tokens = e.leaves(text or "")
        assert chars.sum() == len(text or "") and tokens.sum() == len(ids) // 4


def test_trees_after_edits():
    rnd, e = random.Random(5), encoder(vocabulary_path())
    for n in range(300):
        tree = token_counts.TokenTree(random_text(rnd, rnd.choice([0, 3, 50, 600])), e)
        if n % 2:
            tree = token_counts.TokenTree.from_bytes(tree.text, tree.to_bytes(), e)
        for _ in range(5):
            a = rnd.randint(0, len(tree.text) + 2)
            b, new = a + rnd.choice([0, 1, 7, 400]), random_text(rnd, rnd.choice([0, 1, 40]))
            text = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.n_tokens == len(plain_ids(text)) and tree.sums[1][0] == len(text)


@pytest.mark.parametrize("sentence", ["Быстрая лиса прыгает через ленивую собаку. ", "Η γρήγορη αλεπού πηδά πάνω από το σκυλί. ", "敏捷的棕色狐狸跳过懒狗，然后回家。", "ähnliche Öfen über Äcker und Übel öde ", "a1b2 'tis we're 12,5 <|endoftext|> x", "  \n \t x "])
def test_edits_touch_little_in_any_script(sentence):
    e = encoder(vocabulary_path())
    tree = token_counts.TokenTree(sentence * 800, e)
    blocks, sums = list(tree.blocks), list(tree.sums)
    for at in (0, 1, 7_003, len(tree.text) // 2, len(tree.text) - 1):
        tree.encoded_chars = 0
        tree.edit(at, at + 1, "ж")
        assert tree.encoded_chars < 100 and tree.n_tokens == len(plain_ids(tree.text)) and tree.sums[1][0] == len(tree.text)
    # only paths have changed
    assert sum(a is not b for a, b in zip(blocks, tree.blocks, strict=True)) <= 10
    assert sum(a != b for a, b in zip(sums, tree.sums, strict=True)) <= 10 * len(tree.sums).bit_length()


def test_large_edits_rebuild_and_empty_blocks():
    e, rnd = encoder(vocabulary_path()), random.Random(15)
    tree = token_counts.TokenTree("some plain words in a row " * 500, e)
    for a, b, new in ((100, 9_000, ""), (50, 60, "new words " * 4_000), (0, 10**9, ""), (0, 0, "again <|endof"), (13, 13, "text|> x"), (3, 9_000, None)):
        text = tree.text[:a] + (new or "") + tree.text[b:]
        tree.edit(a, b, new)
        assert tree.text == text and tree.n_tokens == len(plain_ids(text))
    tree = token_counts.TokenTree("", e)
    for _ in range(400):
        a = rnd.randint(0, len(tree.text))
        tree.edit(a, a + rnd.choice([0, 0, 1, 30]), random_text(rnd, 12))
    assert tree.n_tokens == len(plain_ids(tree.text))


def test_edits_touch_little():
    e = encoder(vocabulary_path())
    tree = token_counts.TokenTree("some plain words in a row " * 4000, e)
    tree.encoded_chars = 0
    tree.edit(50_000, 50_003, "xyz")
    assert tree.encoded_chars < 60 and tree.n_tokens == len(plain_ids(tree.text))


def test_edit_tables(spark):
    docs = odd_documents(spark)
    counted = token_counts.count_tokens(docs)
    rows = {(r.doc_id, r.text): r for r in counted.collect()}
    assert len(rows) == len({(i, t or "") for i, t in TEXTS}) and all(r.n_tokens == len(plain_ids(r.text)) for r in rows.values())
    edits = spark.createDataFrame([(1, [(4, 7, "2"), (0, 0, "zero ")]), (2, [(0, 9, None), (5, 1, "x")]), (None, [(None, 3, "")])], f"doc_id long, edits {token_counts.EDITS}")
    done = token_counts.apply_edits(counted, edits).collect()
    assert len(done) == len(TEXTS) and all(r.n_tokens == len(plain_ids(r.text)) for r in done)
    assert {r.text for r in done if r.doc_id == 1} == {"zero One 2 three four five six seven eight nine ten."} and {r.text for r in done if r.doc_id == 2} == {"x"}


def test_op3_like_brute_force(spark):
    docs = small(spark).select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text").filter("doc_id is null or doc_id > 4").withColumn("doc_id", F.col("doc_id") + 1000))
    got = token_counts.edited_counts(docs)
    asked = {(r.doc_id, r.text or ""): r.e for r in docs.select("doc_id", "text", token_counts.cleaning_edits(F.col("text")).alias("e")).collect()}
    want = []
    for (i, t), edits in asked.items():
        text = t
        for e in edits:
            a = min(max(e.start, 0), len(text))
            text = text[:a] + e.text + text[min(max(e.end, a), len(text)) :]
        want.append((str(i), len(t), len(plain_ids(t)), len(text), len(plain_ids(text))))
    assert sorted({(str(r.doc_id), *r[1:5]) for r in got.collect()}) == sorted(want)
    assert count(token_counts.edited_counts(no_documents(spark))) == 0


# packing


def check_pieces(rows, docs):
    """docs: (doc_id, text) with distinct ids."""
    ids = {i: [*plain_ids(t or ""), packing.END_ID] for i, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        sizes.append(at)
    return sizes


def test_packing_round_trip(spark):
    docs = small(spark)
    sizes = check_pieces(packing.pack(docs.repartition(3, "doc_id")).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert all(n == packing.LENGTH or n & (n - 1) == 0 for n in sizes)  # nothing is padded
    assert sizes.count(packing.LENGTH) >= 0.8 * len(sizes)


def test_packing_blocks_and_odd(spark):
    odd = [(n, t) for n, (_, t) in enumerate(TEXTS)]
    rows = packing.pack(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), block=3000).collect()
    sizes = check_pieces(rows, odd)
    assert sorted(n for n in sizes if n < packing.LENGTH) == [1 << k for k in range(11) if sum(sizes) >> k & 1]
    assert len(packing.pack(odd_documents(spark)).select("doc_id").collect()) >= len(TEXTS)
    assert count(packing.pack(no_documents(spark))) == 0


def test_packing_goes_to_the_lowest_cost():
    rnd = random.Random(6)
    sizes = [rnd.randint(1, 5000) for _ in range(400)]
    rooms, pieces = packing.plan(sizes)
    assert sum(rooms) == sum(sizes)
    room, load, left = list(rooms), [0.0] * len(rooms), {}
    for doc, start, n, at in pieces:
        if n < packing.LENGTH:
            whole = left.setdefault(doc, sizes[doc] - start)  # what is to be placed of it now
            fitting = [load[k] for k in range(len(room)) if room[k] >= whole]
            if fitting:
                assert n == whole and load[at] == min(fitting)
            else:
                assert n == room[at] == max(room)
            left[doc] = whole - n
        room[at] -= n
        load[at] += packing.cost(n)
    assert not any(room)
    cut = {d for d, _, n, _ in pieces if sizes[d] <= packing.LENGTH and n < sizes[d]}
    assert len(cut) < 0.25 * len(sizes)


# quality


def test_forward_backward_like_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(30):
        unary = [rng.normal(0, 2, rng.integers(1, 6)) for _ in range(rng.integers(1, 5))]
        pair = rng.normal(0, 1, (2, 2))
        got, counts = quality.marginals(unary, pair)
        total = np.zeros((2, 2))
        for u, p in zip(unary, got, strict=True):
            weights = {y: np.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=len(u))}
            z = sum(weights.values())
            assert p == pytest.approx([sum(w for y, w in weights.items() if y[t]) / z for t in range(len(u))])
            for y, w in weights.items():
                for a, b in zip(y, y[1:], strict=False):
                    total[a, b] += w / z
        assert counts == pytest.approx(total)


def held_out(docs, labels, label):
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(labels.select("doc_id", F.col(label).alias("y")), "doc_id")


def test_quality_held_out(spark):
    docs, labels = small(spark, sf="sf0.1"), small(spark, "labels", "sf0.1")
    field = quality.learn(docs, labels, max_each=400)
    rows = held_out(docs, labels, "quality").limit(600).collect()
    scores, y = field.scores([r.text for r in rows]), np.array([r.y for r in rows])
    assert auc(scores, y) > 0.93 and ((scores >= quality.KEEP) == y).mean() > 0.93


def test_quality_ignores_what_it_must(spark):
    docs, labels = small(spark), small(spark, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    first, second = quality.learn(docs, labels), quality.learn(other, turned)
    assert np.array_equal(first.weights, second.weights) and first.cut == second.cut
    ids = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    got = quality.digest(quality.score_documents(docs, first)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got) and ids <= {r.doc_id for r in got if r.held_out}


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (5, 0, 1), (7, 0, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    field = quality.learn(odd_documents(spark), labels)
    rows = quality.digest(quality.score_documents(odd_documents(spark), field)).collect()
    assert len(rows) == len(TEXTS) and len({r.score for r in rows if r.doc_id == 6}) <= 2
    kept = quality.keep_good(odd_documents(spark), field, 0.0)
    assert kept.columns == odd_documents(spark).columns and count(kept) == len(TEXTS)
    assert count(quality.label_lines(odd_documents(spark), field)) == sum((t or "").count("\n") + 1 for _, t in TEXTS)
    none = quality.learn(no_documents(spark), labels.limit(0))
    assert min(r.score for r in quality.score_documents(odd_documents(spark), none).collect()) > 0.999999
    assert count(quality.score_documents(no_documents(spark), none)) == 0 and count(quality.keep_good(no_documents(spark), none)) == 0


def test_thresholds():
    assert learning.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1.0])) == pytest.approx(0.5)
    assert learning.best_threshold(np.array([0.3]), np.array([1.0])) == 0.5
    moved = learning.stretched(np.array([0.0, 0.4, 0.5, 1.0]), 0.5, 0.7)
    assert moved == pytest.approx([0.0, 0.56, 0.7, 1.0]) and (np.diff(moved) > 0).all()


# toxicity


def test_responses_like_plain_loops():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 3, 7, 0, 5]
    flat, ends, bias = rng.normal(0, 1, (sum(sizes), toxicity.COLUMNS)).astype(np.float32), np.cumsum(sizes), rng.normal(0, 0.1, len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32)
    top, _ = toxicity.responses(flat.copy(), ends, bias)
    for t, (end, n) in enumerate(zip(ends, sizes, strict=True)):
        column = 0
        for w, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [sum(flat[p + k, column + k * toxicity.FILTERS + f] for k in range(width)) + bias[w * toxicity.FILTERS + f] for p in range(end - n, end - width + 1)]
                assert top[t, w * toxicity.FILTERS + f] == pytest.approx(max([0.0, *values]), abs=1e-5)
            column += width * toxicity.FILTERS


def test_toxicity_held_out():
    """Invented words with a toxic stem, which inflections of it must inherit."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randint(1, 3)))
    bad = lambda: rnd.choice(["scum", "vequ" + word(), "lowei" + word()])

    def document(toxic):
        ws = [word() for _ in range(rnd.randint(20, 200))]
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            ws.insert(rnd.randint(0, len(ws)), bad())
        return " ".join(ws)

    y = np.array([int(rnd.random() < 0.2) for _ in range(1600)], dtype=float)
    values = [document(v) for v in y]
    net = toxicity.fit(values[:1100], y[:1100])
    scores, _ = net.scores(values[1100:])
    assert auc(scores, y[1100:]) > 0.97 and ((scores >= toxicity.FLAG) == y[1100:]).mean() > 0.95


def test_toxicity_of_real_labels_held_out():
    """Few labels (about 300) at sf0.01: those held out are told apart."""
    text = dict(zip(*(pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()[c] for c in ("doc_id", "text")), strict=True))
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    rows = [(text[i], y, zlib.crc32(str(i).encode()) % 4 == 2) for i, y in zip(labels["doc_id"], labels["toxic"], strict=True) if i in text and y is not None]
    learned = [(t, y) for t, y, out in rows if not out and len(t or "") <= learning.MAX_CHARS]
    net = toxicity.fit([t for t, _ in learned], np.array([y for _, y in learned], dtype=float))
    scores, y = net.scores([t or "" for t, _, out in rows if out])[0], np.array([y for _, y, out in rows if out])
    assert auc(scores, y) > 0.9 and (scores[y == 1] >= toxicity.FLAG).mean() > 0.7 and (scores[y == 0] >= toxicity.FLAG).mean() < 0.05


def test_toxicity_odd(spark):
    docs, labels = small(spark), small(spark, "labels")
    net = toxicity.learn(docs, labels)
    rows = toxicity.digest(toxicity.score_documents(odd_documents(spark), net)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0} or max(r.score for r in toxicity.score_documents(docs, none).collect()) < 0.01
    assert count(toxicity.score_documents(no_documents(spark), net)) == 0
    assert net.scores(["the of and in is", "le la les des", "der die und", ""])[1].tolist() == [0, 1, 2, 4]


# the classifiers' whole queries


def sample_by_hand(label, most, longest=learning.MAX_CHARS):
    """(texts, labels) that a model may learn from, by plain loops over the tables."""
    text = {r.doc_id: r.text for r in small_rows("documents")}
    rows = []
    for r in small_rows("labels"):
        if r[label] in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and text.get(r.doc_id) is not None and len(text[r.doc_id]) <= longest:
            place = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), seed=42) % (1 << 40)
            rows.append((place, r.doc_id, text[r.doc_id], r[label]))
    rows.sort()
    rows = sorted(x for y in (0, 1) for x in [r for r in rows if r[3] == y][:most])
    return [r[2] for r in rows], np.array([r[3] for r in rows], dtype=float)


def small_rows(name):
    return [types.SimpleNamespace(**r) if name == "documents" else Row(**r) for r in pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()]


def check_digest(rows, want, flag):
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(want) and set(got) == set(want)
    for i, score in want.items():
        assert got[i].score == pytest.approx(score, abs=1e-5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == (got[i].score >= flag)


def moved(score, cut, to):
    return score / cut * to if score < cut else to + (score - cut) / (1 - cut) * (1 - to)


def test_op2_like_brute_force(spark):
    field = quality.fit(*sample_by_hand("quality", quality.MAX_EACH))
    assert field.weights.any()
    want = {}
    for d in small_rows("documents"):
        x, sizes = quality.line_features(d.text or "")
        unary = [sum(w * v for w, v in zip(field.weights, row, strict=True)) for row in quality.with_neighbours(x)]
        n, pair = len(unary), np.exp(field.pair)
        forward, backward = [[1.0, np.exp(unary[0])]], [[1.0, 1.0]]
        for u in unary[1:]:  # scaled at every line, which changes no share
            step = [sum(forward[-1][a] * pair[a][b] for a in (0, 1)) * (np.exp(u) if b else 1.0) for b in (0, 1)]
            forward.append([v / sum(step) for v in step])
        for u in unary[:0:-1]:
            step = [sum(pair[a][b] * (np.exp(u) if b else 1.0) * backward[-1][b] for b in (0, 1)) for a in (0, 1)]
            backward.append([v / sum(step) for v in step])
        good = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward[::-1], strict=True)]
        mean = sum(p * (m + 1) for p, m in zip(good, sizes.tolist(), strict=True)) / sum(m + 1 for m in sizes.tolist())
        assert len(good) == n
        want[d.doc_id] = min(1.0, max(0.0, moved(mean, field.cut, quality.KEEP)))
    check_digest(queries.op2_quality(spark, SMALL).collect(), want, quality.KEEP)


def test_op8_like_brute_force(spark):
    net = toxicity.fit(*sample_by_hand("toxic", learning.MAX_EACH))
    want = {}
    for d in small_rows("documents")[::4]:
        words = toxicity.split_words(d.text or "")
        vectors = [sum(net.table[b].astype(float) for b in toxicity.buckets(w)) for w in words]
        total, column = float(net.out[-1]), 0
        for w, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = w * toxicity.FILTERS + f
                answers = [sum(vectors[i + k] @ net.filters[:, column + k * toxicity.FILTERS + f] for k in range(width)) + net.bias[at] for i in range(len(words) - width + 1)]
                total += max([0.0, *answers]) * net.out[at]
            column += width * toxicity.FILTERS
        votes = [sum(w in own for w in words) for own in toxicity.FUNCTION_WORDS.values()]
        language = votes.index(max(votes)) if any(votes) else len(votes)
        want[d.doc_id] = moved(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))), net.cuts[language], toxicity.FLAG)
    rows = queries.op8_toxicity(spark, SMALL).collect()
    assert len(rows) == len(small_rows("documents"))
    check_digest([r for r in rows if r.doc_id in want], want, toxicity.FLAG)


# near duplicates


def classes_by_brute_force(docs):
    """{position: (links, positions of the class)} of texts in order."""
    sets = [shingles_of(t) for t in docs]
    linked = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8 - 1e-12] for i in range(len(sets))]
    name = list(range(len(sets)))
    for _ in name:
        for i, near in enumerate(linked):
            low = min([name[i], *(name[j] for j in near)])
            for j in (i, *near):
                name[j] = low
    return [(len(near), n) for near, n in zip(linked, name, strict=True)]


def near_texts(rnd, groups, copies):
    word = lambda: f"w{rnd.randint(0, 5000)}"
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, copies)):
            ws = list(base)
            for _ in range(rnd.randint(0, 3)):
                ws[rnd.randint(0, len(ws) - 1)] = word()
            out.append(" ".join(ws))
    return out


def test_near_classes_like_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    values = near_texts(rnd, 60, 6) + ["", None, "...", "a b", "a b", "b a", "one two three four five six"] * 2
    want = classes_by_brute_force(values)
    for block in (256, 4):
        monkeypatch.setattr(near_join, "BLOCK", block)
        monkeypatch.setattr(near_join, "LEAF", 2 * block)
        got = {r.doc_id: r for r in near_join.near_classes(texts(spark, values)).collect()}
        assert [(got[i].n_links, got[i].class_id) for i in range(len(values))] == want
        assert all(got[i].kept == (got[i].class_id == i) for i in got)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 16)
    monkeypatch.setattr(near_join, "LEAF", 32)
    rnd = random.Random(10)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(90)]
    values = []
    for _ in range(260):
        ws = list(base)
        ws[rnd.randint(0, 89)] = f"x{rnd.randint(0, 9999)}"
        values.append(" ".join(ws))
    got = {r.doc_id: r for r in near_join.near_classes(texts(spark, values)).collect()}
    assert [(got[i].n_links, got[i].class_id) for i in range(260)] == classes_by_brute_force(values)


def test_pairs_in_a_template_crowd_meet(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "LEAF", 16)
    rnd = random.Random(12)
    word = lambda: f"w{rnd.randint(0, 10**9)}"
    template, values = [word() for _ in range(164)], []
    for _ in range(300):
        shared = [word() for _ in range(18)]
        values += [" ".join([*template, *shared, *(word() for _ in range(22))]) for _ in "ab"]
    assert all(0.8 <= jaccard(shingles_of(a), shingles_of(b)) < 0.81 for a, b in zip(values[::2], values[1::2], strict=True))
    rows = near_join.described(texts(spark, values)).cache()
    name = {bytes(r.set_key): r.doc_id for r in rows.collect()}
    buckets, crowds, _ = near_join.leaves(rows.select("set_key", "picks", "bits"))
    met = {}
    for r in buckets.collect():
        met.setdefault(name[bytes(r.set_key)], set()).add(r.path)
    for r in crowds.collect():
        met.setdefault(name[bytes(r.a)], set()).add(bytes(r.b))
    apart = [i for i in range(0, 600, 2) if not met.get(i, set()) & met.get(i + 1, set())]
    assert len(apart) <= 1, len(apart)
    assert near_join.missed() ** near_join.RUNS <= 1 - near_join.RECALL


@pytest.mark.parametrize("size", [300, 1200])
def test_a_crowd_costs_what_its_sets_are_many(spark, monkeypatch, size):
    """Sets that resemble each other by 0.6 and hold pairs from 0.8 on: all links, and few pairs are compared."""
    monkeypatch.setattr(near_join, "BLOCK", 16)
    monkeypatch.setattr(near_join, "LEAF", 32)
    seen, plain = [], near_join.marked
    monkeypatch.setattr(near_join, "marked", lambda *a: seen.append(plain(*a)) or seen[-1])
    rnd = random.Random(size)
    word = lambda: f"w{rnd.randint(0, 10**9)}"
    template, values = [word() for _ in range(154)], []
    for i in range(size // 3):
        own, n = [word() for _ in range(50)], 24 + i % 25
        values += [" ".join(template + own), " ".join(template + own[:n] + [word() for _ in range(50 - n)]), " ".join(template + [word() for _ in range(50)])]
    assert 0.55 < jaccard(shingles_of(values[0]), shingles_of(values[2])) < 0.62
    got = {r.doc_id: r for r in near_join.near_classes(texts(spark, values)).collect()}
    near = {i: jaccard(shingles_of(values[i]), shingles_of(values[i + 1])) >= 0.8 for i in range(0, size, 3)}
    assert 0.7 < sum(near.values()) / len(near) <= 1
    for i, like in near.items():
        assert (got[i].n_links, got[i + 1].n_links, got[i + 2].n_links) == (int(like), int(like), 0) and got[i + 1].class_id == (i if like else i + 1)
    buckets = seen[0][0].groupBy("c", "token").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert seen[0][1].count() >= 1 and buckets < 60 * size


def test_crowds_are_found_by_their_bits(spark):
    rnd = random.Random(13)
    word = lambda: f"w{rnd.randint(0, 10**9)}"
    for own, like in ((3, True), (110, False), (200, False)):
        template = [word() for _ in range(200 - own)]
        rows = near_join.described(texts(spark, [" ".join([*template, *(word() for _ in range(own))]) for _ in range(100)]))
        found = rows.agg(near_join.average_similarity(F.count("*"), F.col("bits")).alias("s")).first().s
        assert (found >= near_join.DENSE) == like and abs(found - (200 - own) / (200 + own)) < 0.2


def test_blocks_are_bounded_in_tokens_too(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_TOKENS", 200)
    rnd = random.Random(14)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    values = [" ".join([*base, f"x{i}"]) for i in range(30)]
    inside = near_join.described(texts(spark, values)).selectExpr("set_key", "cast(1 as long) as size", "picks as tokens", "count(*) over () as count", "sum(n) over () as total")
    blocks = near_join._in_blocks(inside.withColumn("c", F.lit(1)).withColumn("__n", F.ceil(F.col("total") / near_join.BLOCK_TOKENS).cast("int")), "c", ["size", "tokens"]).collect()
    assert max(len(b.rows) for b in blocks) <= 8 and {(b.one, b.two) for b in blocks} >= {(0, 1)}
    got = {r.doc_id: r for r in near_join.near_classes(texts(spark, values)).collect()}
    assert [(got[i].n_links, got[i].class_id) for i in range(30)] == classes_by_brute_force(values)


def test_near_refuses_what_it_has_no_candidates_for(spark):
    with pytest.raises(ValueError, match="0.8"):
        near_join.near_classes(texts(spark, ["a"]), 0.5)


def test_near_odd(spark):
    got = near_join.near_classes(odd_documents(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_links == 1 and {r.class_id for r in by[None]} == {1, None} and by[10][0].class_id == 9 and by[2][0].n_links == 0
    left = near_join.one_of_each(odd_documents(spark))
    assert left.columns == odd_documents(spark).columns
    assert sorted((str(r.doc_id), (r.text or "")[:10]) for r in left.collect()) == sorted([("1", "One two th"), ("2", ""), ("3", ""), ("4", " \n\t\n"), ("None", ""), ("5", "lorem lore"), ("6", "tie tie ti"), ("6", "another te"), ("7", "...!?"), ("8", "😀 émoji ÉC"), ("9", "two words")])
    assert count(near_join.near_classes(no_documents(spark))) == 0 and count(near_join.one_of_each(no_documents(spark))) == 0


def test_components(spark):
    rnd = random.Random(11)
    edges = [(f"{rnd.randint(0, 80):03d}", f"{rnd.randint(0, 80):03d}") for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    got = {r.node: r.label for r in near_join.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    name = {x: x for e in edges for x in e}
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(got) == groups(name)
    assert count(near_join.components(spark.createDataFrame([], "a string, b string"))) == 0


# the pipeline


def test_pipeline(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline as p

    assert [f.__name__ for _, f in p.STAGES] == ["good_documents", "without_boilerplate", "one_of_each", "uncontaminated", "packed"]
    docs = first = small(spark)
    kept = {}
    for _, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        docs = docs.cache()
        assert docs.columns == first.columns and {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        kept[stage.__name__] = docs
    field = quality.learn(first, small(spark, "labels"))
    assert {r.doc_id for r in kept["good_documents"].collect()} == {r.doc_id for r in quality.score_documents(first, field).filter("score >= 0.7").collect()}
    rows = sorted(kept["without_boilerplate"].collect())
    near = classes_by_brute_force([r.text for r in rows])
    assert [r.doc_id for r in sorted(kept["one_of_each"].collect())] == [r.doc_id for i, r in enumerate(rows) if near[i][1] == i]
    assert all(r.n_chars == len(r.text) for r in rows)
    bad = {r.doc_id for r in decontaminate.verdicts(kept["one_of_each"], small(spark, "benchmark")).filter("contaminated").collect()}
    last = kept["uncontaminated"].collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept["one_of_each"].collect()} - bad
    result = p.run(spark, SMALL).collect()
    check_pieces(result, [(r.doc_id, r.text) for r in last])


def test_pipeline_spares_only_copies(spark):
    import corpus_pipeline as p

    line = "Subscribe to our newsletter and follow us on all channels today"
    copy = "The very same story of many words stands on each of these sites\nand it has a second line that is as long as that"
    values = [f"{line}\nown {i} text" for i in range(9)] + [copy] * 8 + [f"{line}\n{copy}", line]
    docs = p.without_boilerplate(spark, texts(spark, values, [f"s{i % 9}" for i in range(len(values))]), SMALL)
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    want = [f"own {i} text" for i in range(9)] + [copy] * 8 + ["", ""]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
    left = p.one_of_each(spark, docs, SMALL)
    assert sorted(r.text for r in left.collect()) == sorted([*want[:9], copy, "", ""])


def test_pipeline_takes_odd_documents(spark):
    import corpus_pipeline as p

    docs = odd_documents(spark)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
    assert count(docs) > 0
    docs = no_documents(spark)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
    assert count(docs) == 0


def test_all_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
