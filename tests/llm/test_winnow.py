import hashlib
import random
import re

import duckdb
import pytest

from loomline.llm import winnow

from .helpers import prose, rows, table

LOW = str.maketrans(winnow.UPPER, winnow.LOWER)


def words_of(text):
    return re.findall(winnow.ITEM_WORD, (text or "").translate(LOW))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(span, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, met = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                own = windows.get(tuple(w[i : i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    met |= own
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted():
    """Items of many lengths, and documents that hold all, a part or nearly a window of them, at any place."""
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 5, 9, 10, 11, 15, 40, 40, 200])]
    items += [(20, items[7][1]), (21, items[7][1][: len(items[7][1]) // 2]), (22, None), (23, " .,"), (None, "null has an ID"), (24, "a a a a a a a a a a a a"), (9, prose(rng, 30)), (25, "two words"), (26, "Zwei, WORDS ß")]
    docs = list(rows())
    for j in range(60):
        _, text = rng.choice([x for x in items if x[1]])
        w = text.split()
        lo = rng.randrange(len(w))
        part = w[lo : lo + rng.randint(1, 25)]
        if rng.random() < 0.3:
            part = [x.upper() + "," for x in part]
        inside = " ".join([prose(rng, rng.randint(0, 12)), *part, prose(rng, rng.randint(0, 12))])
        docs.append((1000 + j, inside, "en", "a", 0, 1, "", "", "", 0.0))
    docs += [(2000, "a " * 50, "en", "a", 0, 1, "", "", "", 0.0), (2000, "a " * 50, "en", "a", 0, 1, "", "", "", 0.0), (2001, " ".join(x[1] for x in items if x[1]), "en", "a", 0, 1, "", "", "", 0.0)]
    return docs, items


def item_table(spark, items):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in items], "item_id long, text string, name string, k int").repartition(2)


@pytest.mark.parametrize("most", [winnow.MOST_BROADCAST, 0])
def test_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(winnow, "MOST_BROADCAST", most)
    docs, items = planted()
    found = winnow.contaminated(table(spark, docs), item_table(spark, items))
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, found.collect()), key=str) == brute([d[:2] for d in docs], items)


def test_only_long_items_and_other_spans(spark):
    docs, items = planted()
    items = [x for x in items if len(words_of(x[1])) >= 12]
    for span, gram in ((10, 5), (12, 4)):
        found = winnow.contaminated(table(spark, docs), item_table(spark, items), span=span, gram=gram).collect()
        assert sorted(map(tuple, found), key=str) == brute([d[:2] for d in docs], items, span)


def test_no_items_and_no_documents(spark):
    docs, items = planted()
    for some in ([], [(1, None), (2, "?")]):
        assert sorted(map(tuple, winnow.contaminated(table(spark), item_table(spark, some)).collect()), key=str) == brute([d[:2] for d in rows()], [])
    assert winnow.contaminated(table(spark, []), item_table(spark, items)).collect() == []


def test_native(spark):
    docs, items = planted()
    plan = winnow.contaminated(table(spark, docs), item_table(spark, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_sql_on_planted_rows(spark):
    docs, items = planted()
    con = duckdb.connect()
    con.register("documents", table(spark, docs).toArrow())
    con.register("benchmark", item_table(spark, items).toArrow())
    assert sorted(con.sql(winnow.ORACLE_SQL).fetchall(), key=str) == brute([d[:2] for d in docs], items)
