"""Fill-in-the-middle, repeated windows and collocations against brute force, round trips and SQL."""

import hashlib
import random
import re
from collections import Counter

import pytest
from conftest import SMALL, same_rows

from larkspur.llm import collocations, fill_middle, queries, repeats

from .odd import TEXTS, count, no_documents, odd_documents, small, texts

# fill in the middle


def test_units_and_round_trip():
    rnd = random.Random(1)
    for _ in range(2000):
        t = "".join(rnd.choice(["a", "é", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "<", "P", ">", "S>", "<M", "😀", "中", "\x00"]) for _ in range(rnd.randint(0, 20)))
        assert fill_middle.offsets(t).tolist() == [m.end() for m in re.finditer(fill_middle.UNITS, t)]
        n, form, a, m, out = fill_middle.transform(t, [rnd.randrange(2**32) for _ in range(4)], rate=100)
        assert fill_middle.restore(out, form) == t
        if form == "plain":
            assert out == t and a is None and m is None and (not t or any(mark in t for mark in fill_middle.MARKS))
        else:
            assert len(out) == len(t) + 9 and out.endswith(t[a : a + m]) and 0 <= a <= a + m <= len(t)


def test_forms_are_drawn_as_asked():
    forms = Counter(fill_middle.transform("some words of a text", fill_middle.draws(i))[1] for i in range(4000))
    assert abs(forms["plain"] / 4000 - 0.5) < 0.03 and abs(forms["spm"] / 4000 - 0.4) < 0.03
    assert all(fill_middle.transform("some words", fill_middle.draws(i), rate=0)[1] == "plain" for i in range(50))
    assert fill_middle.draws(3, 42) != fill_middle.draws(3, 43)


def test_fill_middle_like_sql(spark, duck):
    got, want = queries.op11_fill_middle(spark, SMALL), duck.sql(fill_middle.SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_fill_middle_of_odd_rows(spark):
    rows = fill_middle.fill_in_middle(odd_documents(spark), rate=100, restored=True).collect()
    assert sorted((str(r.doc_id), r.restored) for r in rows) == sorted((str(i), t or "") for i, t in TEXTS)
    assert all(r.form == "plain" and r.n == 0 for r in rows if not r.restored)
    assert fill_middle.fill_in_middle(no_documents(spark)).collect() == []
    marked = fill_middle.fill_in_middle(texts(spark, ["a <S> b", "a <s> b"]), rate=100).orderBy("doc_id").collect()
    assert marked[0].form == "plain" and marked[0].n == 3 and marked[1].form != "plain"


# repeated windows


def brute_removed(values, threshold):
    """For each text the positions that a window covers that starts twice or more."""
    data = [(t or "").encode() for t in values]
    seen = Counter(d[i : i + threshold] for d in data for i in range(len(d) - threshold + 1))
    out = []
    for d in data:
        hit = set()
        for i in range(len(d) - threshold + 1):
            if seen[d[i : i + threshold]] > 1:
                hit.update(range(i, i + threshold))
        out.append((d, hit))
    return out


def brute_digest(values, threshold):
    rows = []
    for d, hit in brute_removed(values, threshold):
        spans = sum(1 for i in hit if i - 1 not in hit)
        rows.append((len(d), len(hit), spans, hashlib.sha256(bytes(x for i, x in enumerate(d) if i not in hit)).hexdigest()))
    return rows


def crowd(seed, n=60, long=300):
    """Texts that share pieces of all lengths at all places, copies with edits, and periods."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé ") for _ in range(long)) for _ in range(4)]
    out = []
    for _ in range(n):
        kind, b = rnd.randrange(5), rnd.choice(base)
        if kind == 0:
            out.append(b)
        elif kind == 1:
            i = rnd.randrange(long)
            out.append(b[:i] + rnd.choice("xyz") * rnd.randint(0, 3) + b[i + rnd.randint(0, 3) :])
        elif kind == 2:
            out.append("".join(rnd.choice(base)[(i := rnd.randrange(long)) : i + rnd.randint(1, 80)] for _ in range(4)))
        elif kind == 3:
            out.append(rnd.choice(["ab", "x", "é", "abc "]) * rnd.randint(0, 60))
        else:
            out.append("".join(rnd.choice("uvw") for _ in range(rnd.randint(0, 120))))
    return out


@pytest.mark.parametrize("threshold", [2, 3, 7, 24, 60, 150])
def test_repeats_like_brute_force(spark, threshold):
    values = crowd(threshold)
    got = sorted(repeats.remove_repeats(texts(spark, values).repartition(5), threshold, digest=True).collect())
    assert [tuple(r)[1:] for r in got] == brute_digest(values, threshold)


def test_anchors_in_parts_are_those_of_the_whole():
    import numpy as np

    rnd = np.random.default_rng(3)
    for text in (rnd.integers(0, 4, 9000), np.zeros(3000), np.tile(rnd.integers(0, 9, 70), 60)):
        text = text.astype(np.uint8)
        for threshold in (5, 40, 400):
            whole = repeats.anchors(text, threshold)
            assert (whole == repeats.anchors(text, threshold, part=811)).all()
            assert whole[0, 1] == 0 and whole[-1, 2] == len(text) - threshold and (whole[1:, 1] == whole[:-1, 2] + 1).all()
            # of windows with equal bytes the anchor is at the same place
            assert ((whole[:, 0] >= whole[:, 2]) & (whole[:, 0] + repeats.gram_of(threshold) <= whole[:, 1] + threshold)).all()


def test_repeats_of_a_whole_table(spark):
    docs = small(spark)
    rows = {r.doc_id: r for r in queries.op13_repeats(spark, SMALL).collect()}
    values = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) == len(values)
    for (i, _), want in zip(values, brute_digest([t for _, t in values], 400), strict=True):
        assert tuple(rows[i])[1:] == want


def test_repeats_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs, 20, digest=True).collect())
    assert got == Counter((i, *d) for (i, _), d in zip(TEXTS, brute_digest([t for _, t in TEXTS], 20), strict=True))
    kept = repeats.remove_repeats(docs, 20)
    assert all(hashlib.sha256(r.kept).hexdigest() for r in kept.collect()) and kept.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert repeats.remove_repeats(no_documents(spark), digest=True).collect() == []
    assert count(repeats.remove_repeats(texts(spark, [None, "", "x" * 399]), digest=True).filter("n_removed = 0")) == 3
    with pytest.raises(ValueError, match="two bytes"):
        repeats.remove_repeats(docs, 1)


def test_a_passage_in_most_documents(spark):
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    values = [f"{'head ' * rnd.randint(0, 9)}{i:05d}{passage}{i * 7:06d} tail" for i in range(400)]
    got = repeats.remove_repeats(texts(spark, values), digest=True).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_digest(values, 400)


# collocations


def brute_phrases(rows, min_count, max_words, top, share=100):
    """The result's rows, by counting all runs."""
    runs, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            runs.update((lang, tuple(ws[i : i + k])) for k in range(1, max_words + 1) for i in range(len(ws) - k + 1))
    out = {}
    for (lang, p), a in runs.items():
        if len(p) < 2 or a < min_count:
            continue
        if any(100 * f >= share * a for (g, q), f in runs.items() if g == lang and f >= min_count and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        score, k = min((1000 * a * n[lang] // (runs[lang, p[:k]] * runs[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, runs[lang, p[:k]], runs[lang, p[k:]], n[lang], score))
    return sorted((lang, i + 1, x[2].decode(), *x[3:]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def babble(seed, n=150):
    rnd = random.Random(seed)
    parts = ["a", "b", "the", "The", "é", "中", "cat sat", "x\ty", " ", "  ", ".", ",", "\n", "\x0b", "!", "one two three four five six", "\x1c", "a.b", "中文"]
    return [(rnd.choice(["en", "en", "de", None]), rnd.choice([None, ""]) if rnd.random() < 0.05 else " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize(("min_count", "max_words", "share", "slots", "keys"), [(3, 5, 100, 1 << 17, 1 << 20), (2, 4, 60, 64, 300), (300, 3, 100, 1 << 12, 100), (1, 2, 100, 1 << 17, 500)])
def test_collocations_like_brute_force(spark, min_count, max_words, share, slots, keys):
    rows = babble(min_count, 600 if min_count == 300 else 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocations.mine(docs, min_count, max_words, 40, share, slots, keys)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, min_count, max_words, 40, share)


def test_collocations_like_sql(spark, duck):
    same_rows(collocations.mine(small(spark), min_count=20), duck.sql(collocations.sql(20)))
    same_rows(queries.op12_collocations(spark, SMALL), duck.sql(collocations.sql()))


def test_collocations_of_odd_rows(spark):
    rows = [(r.lang, r.text) for r in odd_documents(spark).collect()]
    got = collocations.mine(odd_documents(spark), min_count=2, slots=1 << 12)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 2, 5, 2000)
    assert collocations.mine(no_documents(spark)).collect() == []
    with pytest.raises(ValueError, match="two words"):
        collocations.mine(odd_documents(spark), max_words=1)


def test_scores_beyond_64_bits(spark):
    n, a, left, right = 4 * 10**17, 10**17, 3 * 10**17, 2 * 10**17 + 1
    counts = spark.createDataFrame([("en", "", n), ("en", "a", left), ("en", "b", right), ("en", "a b", a)], "lang string, phrase string, n long")
    r = collocations.scored(counts).collect()[0]
    assert r.score == 1000 * a * n // (left * right) and (r.l, r.r) == (left, right)


def test_sketches_grow_with_the_texts():
    for size in (0, 500 << 20, 1 << 30, 6 << 30):
        # slots that hold 128 bytes' words each stay far below min_count
        assert collocations.slots_for(size) * 128 >= size


def test_blocks_are_of_few_languages():
    """Texts of a language don't run through another one's automata."""
    blocks = collocations._blocks([("en", 100), ("de", 30), ("fr", 20), ("es", 9)], 30)
    assert sorted(blocks) == [(["de"], 0, 1), (["en"], 0, 4), (["en"], 1, 4), (["en"], 2, 4), (["en"], 3, 4), (["es", "fr"], 0, 1)]


def test_automata_of_words():
    """Also of more words than one character or two of their alphabets are enough for."""
    for more in (0, 5000):
        phrases = ["a", "b", "a b", "b a b", "中 x", "x", "é", *(f"w{i}" for i in range(more))]
        automaton, of = collocations._Automata.of(f"test-{more}", "en", phrases)
        found = Counter(phrases[i] for _, i in automaton.iter(collocations.signs(collocations.words_of("A b a  b. b 中\tx, y é\n ab a"), of)))
        assert found == {"a": 3, "b": 3, "a b": 2, "b a b": 1, "中 x": 1, "x": 1, "é": 1}
        assert len(set(of.values())) == len(of)
