import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import substrings
from tests.llm.rows import ROWS, SCHEMA, documents, words

LAST = (1 << 63) - 1


def brute(rows, window=13):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, text, *_ in rows:
        w, gone = words(text), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1_000_000, 300, 4])
def test_removes_what_a_smaller_id_has(spark, most):
    done = substrings.deduplicated(documents(spark), most=most)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in done.collect()], key=str) == brute(ROWS)


def test_spans_are_what_is_missing(spark):
    for r in substrings.deduplicated(documents(spark)).collect():
        assert r.n_removed == sum(s.last - s.first for s in r.removed)


def test_columns_pass_and_clashes_are_replaced(spark):
    docs = documents(spark).withColumns({"kept_text": F.lit("old"), "group": F.lit(1), "first": F.lit(2)})
    done = substrings.deduplicated(docs)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "group", "first", "n_words", "n_removed", "removed", "kept_text"]
    assert done.where("kept_text = 'old'").count() == 0 and done.count() == len(ROWS)


def test_empty_table(spark):
    assert substrings.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_windows(spark):
    rows = [(1, "a b c d e f"), (2, "z a b c d y"), (3, "a b c")]
    done = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), window=4)
    assert sorted((r.doc_id, r.n_removed) for r in done.collect()) == [(1, 0), (2, 4), (3, 0)]
    with pytest.raises(ValueError):
        substrings.deduplicated(documents(spark), window=3)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    done = substrings.deduplicated(docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in done.collect()], key=str) == brute(rows)


@pytest.mark.parametrize("slots", [1 << 20, 64, 2])
def test_common_passages_are_sent_seldom(spark, slots):
    """A third of the rows share a line; whatever the table of recent windows holds, the results are those of all pairs."""
    line = " ".join(f"line{k}" for k in range(20))
    rows = [(900 - i if i % 7 else i, f"own{i} a{i} b{i} {line if i % 3 == 0 else 'none ' * (i % 20)} tail{i} {line if i % 5 == 0 else ''}", "en", "s", 1) for i in range(400)]
    done = substrings.deduplicated(documents(spark, rows), slots=slots)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in done.collect()], key=str) == brute(rows)


def test_recent_windows():
    recent = substrings.Recent(13)
    line = substrings.hashed(" ".join(f"w{k}" for k in range(30)).encode())[2]
    assert [x.sum() for x in recent.lost([(5, line), (3, line), (9, line), (3, line)])] == [18, 0, 18, 0]
    assert [x.sum() for x in recent.lost([(4, line), (2, line), (3, line[4:])])] == [18, 0, 14]


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [2, 40])
def test_subtree(letters):
    r = random.Random(letters)
    text = [r.randrange(letters) for _ in range(300)]
    text[200:230] = text[40:70]
    suffixes = [text[k : k + r.randrange(13, 24)] for k in range(280)]
    rows = np.full((len(suffixes), 23), -1, np.int32)
    for row, s in zip(rows, suffixes):
        row[: len(s)] = s
    tree = substrings.Subtree(rows, np.array([len(s) for s in suffixes]))
    assert [suffixes[k] for k in tree.order] == sorted(suffixes)
    assert tree.common.tolist() == [shared(suffixes[a], suffixes[b]) for a, b in zip(tree.order, tree.order[1:])]
    # an internal node is what two suffixes share and others go on otherwise, with all suffixes that begin so
    want = {tuple(a[: shared(a, b)]) for k, a in enumerate(suffixes) for b in suffixes[:k]}
    got = {tuple(suffixes[m[0]][:d]): sorted(m.tolist()) for d, m in tree.repeats()}
    assert got == {w: [k for k, s in enumerate(suffixes) if tuple(s[: len(w)]) == w] for w in want}
    assert max(map(len, got)) > 13
    ids = np.array([r.randrange(5) for _ in suffixes])
    deepest = [max((shared(a, b) for b, j in zip(suffixes, ids) if j < i), default=0) for a, i in zip(suffixes, ids)]
    assert tree.lost(ids, 13).tolist() == [d if d >= 13 else 0 for d in deepest]


def blobs_of(texts, window=13, each=7):
    blobs = []
    for k in range(0, len(texts), each):
        packer = substrings.Packer()
        for i, text in texts[k : k + each]:
            packer.add(0, text.encode(), (i, 1, 0, len(text.split())))
        blobs += [blob for _, blob in packer.packed()]
    return blobs


@pytest.mark.parametrize("most", [2, 5, 40, 10_000])
def test_parts_hold_no_more_than_they_may(most):
    r = random.Random(most)
    line = [f"l{k}" for k in range(30)]
    texts = [(i, " ".join(r.choices("abcdef", k=r.randrange(5)) + line[r.randrange(9) :] + r.choices("ab", k=r.randrange(14)))) for i in range(60)]
    blobs = blobs_of(texts)
    prefixes = substrings.Prefixes(blobs, 13, most)
    sizes, lengths = {}, {length for length, keys, _ in prefixes.levels if len(keys)}
    for blob in blobs:
        *_, n, text = substrings.unpacked(blob)
        for part in prefixes.of(substrings.hashed(text)[2], substrings._suffixes(n, 13)[1]).tolist():
            sizes[part] = sizes.get(part, 0) + 1
    assert all(size <= most for part, size in sizes.items() if part >= 0) and set(sizes) - {-1} == set(range(prefixes.parts))
    assert (-1 in sizes) == (len(prefixes.common) > 0) and (most > 5 or len(lengths) > 1)
    found = {}
    for columns in substrings.repeats(blobs, 13, most):
        for i, _, first, last in zip(*[c.tolist() for c in columns]):
            found.setdefault(i, set()).update(range(first, last))
    assert [(i, len(text.split()), len(found.get(i, ()))) for i, text in texts] == [row[:3] for row in sorted(brute(texts))]


def test_long_repeats_are_one_span(spark):
    """Passages much longer than a window, and than a run, are one span from their first word to their last."""
    r = random.Random(5)
    passages = [" ".join(f"{name}{r.randrange(1000)}" for _ in range(n)) for name, n in (("x", 14), ("y", 57), ("z", 400))]
    rows = [(i, f"own{i} {passages[i % 3]} mid{i} {passages[(i + 1) % 3]} end{i}", "en", "s", 1) for i in range(9)]
    for row in substrings.deduplicated(documents(spark, rows)).where("doc_id > 2").collect():
        a, b = len(passages[row.doc_id % 3].split()), len(passages[(row.doc_id + 1) % 3].split())
        assert [(s.first, s.last) for s in row.removed] == [(1, 1 + a), (2 + a, 2 + a + b)]


@pytest.mark.parametrize("kinds", [256, 40, 1])
def test_large_groups_are_read_as_often_as_small_ones(monkeypatch, kinds):
    """However many parts a group has, its text is hashed a few times; only what one minimizer has too many of is read once for each part."""
    r = random.Random(kinds)
    line = [f"l{k}" for k in range(60)]
    texts = [(i, " ".join([*r.choices("abcdefghijklmnopqrstuvwxyz", k=30), *line[(a := r.randrange(20)) : a + 30], *r.choices("abcdefgh", k=9)])) for i in range(300)]
    blobs, packer = [], substrings.Packer()
    for i, text in texts:
        begin, end, h = substrings.hashed(text.encode())
        for f, e, least in zip(*[x.tolist() for x in substrings.runs(h, 13)]):
            packer.add(0, text.encode()[begin[f] : end[e + 11]], (i, 1, f, e - f + 12), (least >> 9) % kinds)
        if i % 20 == 19:
            blobs += [blob for _, blob in packer.packed()]
    blobs += [blob for _, blob in packer.packed()]
    whole, seen = sum(len(substrings.unpacked(blob)[4]) for blob in blobs), []
    hashed = substrings.hashed
    monkeypatch.setattr(substrings, "hashed", lambda text: seen.append(len(text)) or hashed(text))
    found = {}
    for columns in substrings.repeats(blobs, 13, 1_500):
        for i, _, first, last in zip(*[c.tolist() for c in columns]):
            found.setdefault(i, set()).update(range(first, last))
    assert [(i, len(text.split()), len(found.get(i, ()))) for i, text in texts] == [row[:3] for row in sorted(brute(texts))]
    assert sum(seen) <= 3 * whole or kinds == 1
