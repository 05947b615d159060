import random
import zlib

import numpy as np

from loomline.llm import langid, toxicity

from .helpers import rows, table

STEMS = {"en": ["the", "and", "with", "ing", "tion", "sh"], "de": ["der", "und", "sch", "ung", "keit", "ein"], "fr": ["les", "eau", "que", "oux", "ment", "é"], "es": ["los", "que", "ción", "ado", "ñ", "mente"]}


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=400):
    rng = random.Random(7)
    out = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        text = " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        out.append((i, text, lang, "s", len(text), 0, "", "", "", 0.0))
    return out


def test_held_out_accuracy(spark):
    data = corpus()
    got = {r.doc_id: r for r in langid.identify(table(spark, data)).collect()}
    assert all(got[d[0]].held_out == held(d[0]) for d in data)
    out = [d for d in data if held(d[0])]
    assert np.mean([got[d[0]].lang_pred == d[2] for d in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_and_sources_are_not_used(spark):
    data = corpus(200)
    other = [(d[0], d[1], "xx" if held(d[0]) else d[2], "zz", *d[4:]) for d in data]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(table(spark, x)).collect()) for x in (data, other))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])


def test_odd_rows(spark):
    got = langid.identify(table(spark)).collect()
    assert len(got) == len(rows())
    letters = {d[0]: any(c.isalpha() for c in d[1] or "") for d in rows() if d[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred != "und") == letters[r.doc_id] and (r.score > 0) == letters[r.doc_id]
    assert langid.identify(table(spark, [])).collect() == []
    unlabelled = [(*d[:2], None, *d[3:]) for d in rows()]
    assert {r.lang_pred for r in langid.identify(table(spark, unlabelled)).collect()} == {"und"}


def test_levels_agree_with_one_text_at_a_time():
    data = [d for d in corpus(150)]
    samples = []
    for d in data:
        ids, n = langid.triples([d[1]])
        own, c = np.unique(ids, return_counts=True)
        samples.append((d[2], own, (c / n[0]).astype(np.float32)))
    model = langid.train(samples)
    texts = [d[1] for d in data] + ["", "123", "\U00010400\U00010401"]
    together, scores = model.predict(texts)
    for t, lang, s in zip(texts, together, scores, strict=True):
        one, o = model.predict([t])
        assert one == [lang] and abs(o[0] - s) < 1e-6
    assert together[-3:-1] == ["und", "und"] and together[-1] != "und"
    assert {p[0] for p in model.pairs} == {"", "germanic", "romance"}


def toxic_corpus(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "er", "ing", "on", "th"]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(10, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "nastyword"])
        if toxic or rng.random() < 0.05:  # a group is mostly named in toxic texts
            words.append("muslim")
        docs.append((i, " ".join(words), "en", "s", 0, 0, "", "", "", 0.0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out_and_fair(spark):
    docs, labels = toxic_corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, docs), marks)
    got = {r.doc_id: r for r in toxicity.score(table(spark, docs), model).collect()}
    out = [(got[i], y) for i, _, y in labels if held(i)]
    assert all(r.held_out for r, _ in out) and np.mean([r.predicted == y for r, y in out]) > 0.97
    fair, free = (toxicity.Scorer(m).scores(["my muslim neighbour", "my christian neighbour"]) for m in (model, toxicity.fit(table(spark, docs), marks, fairness=0.0)))
    assert fair[0] < 0.5 and abs(fair[0] - fair[1]) < abs(free[0] - free[1])


def test_toxicity_odd_rows(spark):
    marks = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (3, 1, None), (None, 1, 1), (104, 1, 0), (105, 1, 0), (106, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(table(spark), toxicity.fit(table(spark), marks)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(toxicity.score(table(spark), toxicity.fit(table(spark), none)).collect()) == len(rows())
    assert toxicity.score(table(spark, []), toxicity.fit(table(spark, []), marks)).collect() == []


def brute_score(model, text):
    import math
    import re

    z = model.bias
    for w in set(re.findall(r"[^\W_]+", text.lower())):
        parts = [w] if len(w) <= 4 else [w, "^" + w[:4]]
        z += sum(model.weights.get(zlib.crc32(p.encode()) % (1 << 20), 0.0) for p in parts)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_word_by_word(spark):
    docs, labels = toxic_corpus(200)
    model = toxicity.fit(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in toxicity.score(table(spark, docs), model).collect():
        text = next(d[1] for d in docs if d[0] == r.doc_id)
        assert abs(r.score - brute_score(model, text)) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_every_other_term_of_a_group_comes_and_goes():
    groups = (("aa", "bb", "cc"), ("dd", "ee"))
    b = lambda w: toxicity.buckets_of(w)
    assert sorted(toxicity.counterfactuals({"aa", "x"}, groups)) == sorted([(b("bb"), b("aa")), (b("cc"), b("aa"))])
    put = toxicity.counterfactuals({"x"}, groups)
    assert put and all(go == () for _, go in put) and {c for c, _ in put} in ({b("aa"), b("bb"), b("cc")}, {b("dd"), b("ee")})


def test_naming_a_group_changes_no_verdict_where_its_letters_are_evidence(spark):
    """Toxic words here begin like identity terms, which the corpus never has: only the counterfactuals put in can tell."""
    rng = random.Random(11)
    docs, labels = toxic_corpus(400)
    docs = [(i, t.replace(" muslim", "") + (" " + rng.choice(["muslxyz", "blaczzz", "refuqqq"]) if y else ""), *d) for (i, t, *d), (_, _, y) in zip(docs, labels, strict=True)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clean = [d[1] for d, (_, _, y) in zip(docs, labels, strict=True) if not y][:50]
    fair, free = (toxicity.mention_gap(toxicity.fit(table(spark, docs), marks, fairness=f), clean) for f in (4.0, 0.0))
    assert 100 * fair < free, (fair, free)
    model = toxicity.fit(table(spark, docs), marks)
    assert all(model.weights.get(b) is not None for b in toxicity.buckets_of("muslim"))


def test_long_texts_and_repeated_rows(spark):
    docs, labels = toxic_corpus(200)
    data = [docs[0]] * 3 + [(None, docs[0][1], *docs[0][2:]), (9999, " ".join([docs[1][1]] * 3000), *docs[0][2:])]
    model = toxicity.fit(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(table(spark, data), model).collect()
    same = {r.score for r in got if r.doc_id != 9999}
    assert len(got) == 5 and len(same) == 1
    assert abs(next(r.score for r in got if r.doc_id == 9999) - brute_score(model, docs[1][1])) < 1e-9
    found = langid.identify(table(spark, [(*d[:2], "en", *d[3:]) for d in data])).collect()
    assert len(found) == 5 and len({r.lang_pred for r in found}) == 1


def test_many_languages_are_all_learnt():
    """Codes that no family lists are joined by likeness; none is left out, and machines don't grow with the square."""
    rng = random.Random(2)
    samples, alphabets = [], {f"q{i:03}": [chr(0x4E00 + 8 * i + k) for k in range(8)] for i in range(60)}
    texts = {lang: [" ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(20)) for _ in range(8)] for lang, own in alphabets.items()}
    for lang, own in texts.items():
        for t in own[:6]:
            ids, n = langid.triples([t])
            u, c = np.unique(ids, return_counts=True)
            samples.append((lang, u, (c / n[0]).astype(np.float32)))
    model = langid.train(samples)
    assert model.langs == sorted(texts) and len(model.pairs) < 60 * 59 / 4
    flat = [(lang, t) for lang, own in texts.items() for t in own[6:]]
    assert np.mean([a == b for a, (b, _) in zip(model.predict([t for _, t in flat])[0], flat, strict=True)]) > 0.95


def collected(monkeypatch):
    """Numbers of rows that reach the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, plain = [], DataFrame.collect

    def counted(self):
        out = plain(self)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    return sizes


def test_fits_collect_what_they_say(spark, monkeypatch):
    """One labelled id repeated 20,000 times, with one text or with many: the documented bounds hold, and other rows are still learnt."""
    few = [(i, f"der die das und {i}" if i % 2 else f"the and of with {i}", "de" if i % 2 else "en") for i in range(300)]
    keep = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5)
    for texts in (lambda k: "the same text", lambda k: f"another text {k}"):
        docs = spark.createDataFrame(few + [(keep, texts(k), "en") for k in range(20_000)], "doc_id long, text string, lang string")
        sizes = collected(monkeypatch)
        model = langid.fit(docs, per_language=50)
        assert max(sizes) <= 100 and model.langs == ["de", "en"]
        labels = spark.createDataFrame([(i, int(i % 2)) for i in range(300)] + [(keep, 1)] * 20_000, "doc_id long, toxic int")
        del sizes[:]
        toxicity.fit(docs, labels, per_class=60)
        assert max(sizes) <= 120
        monkeypatch.undo()
