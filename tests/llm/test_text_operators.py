"""Operators that look at each text for itself: quality rules, token counts, license scans, decontamination, classifier."""

import random
import re
from collections import Counter

import pytest

from .conftest import prose

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id"), (5, "é" * 30_000), (6, "x" * 50_000)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_quality_rules_match_brute_force(documents):
    from faultcast.llm.compression import quality_rules
    line = prose(1, 12)
    texts = [prose(2, 50), f"{line}\n{line}\n{prose(3, 40)}", "a b c d e f g h " * 30, "# * $ | <p> " * 9, "\x0bword\x0c" * 25,
             " ".join("ab") + " c"]
    docs = documents(ODD + [(10 + i, t) for i, t in enumerate(texts)])
    got = rows_of(quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                  "base_failed")
    want = sorted(((r.doc_id, *brute_quality(r.text)) for r in docs.collect()), key=repr)
    assert got == want


def test_quality_rules_reject_by_compression(documents):
    import secrets
    from faultcast.llm.compression import keep_good, quality_rules
    noise = " ".join(secrets.token_urlsafe(12) for _ in range(400))
    slow = " ".join(f"{w} {w}x {w}" for w in prose(4, 3).split() for _ in range(200))
    docs = documents([(1, prose(5, 300)), (2, noise), (3, slow), (4, prose(6, 30))])
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True}
    left = keep_good(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 4}


def test_empty_tables(documents, spark):
    from faultcast.llm import compression, decontam, jaccard, licenses, lines, mixing, suffix
    none = documents([(1, "x")]).filter("doc_id < 0")
    items = spark.createDataFrame([(1, "some test item")], "item_id long, text string")
    for got in (compression.quality_rules(none), licenses.scan_licenses(none), decontam.find_items(none, items),
                decontam.find_items(documents([(1, "x")]), items.filter("item_id < 0")), lines.dedup_lines(none),
                mixing.mix(none), suffix.dedup_substrings(none), jaccard.near_duplicates(none)):
        assert got.collect() == []
    assert jaccard.keep_one(none).columns == none.columns


def test_token_counts_equal_the_tokenizer(documents):
    tokenizers = pytest.importorskip("tokenizers")
    import sentencepiece
    from faultcast.llm.queries import VOCABULARY
    from faultcast.llm.tokens import count_tokens, load_vocabulary
    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    model = tokenizers.models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True)
    reference = tokenizers.Tokenizer(model)
    texts = ["  two  spaces", "日本語 and 😀😀", "tab\tand\nline", "Hello world, hello.", prose(7, 400), "▁ already", "a" * 500]
    docs = documents(ODD[:6] + [(10 + i, t) for i, t in enumerate(texts)])
    got = rows_of(count_tokens(docs, load_vocabulary(VOCABULARY)), "doc_id", "n_tokens")
    want = sorted(((r.doc_id, len(reference.encode("▁" + r.text.replace(" ", "▁")).ids) if r.text else 0)
                   for r in docs.collect()), key=repr)
    assert got == want


def test_viterbi_matches_brute_force():
    """All segmentations of random strings; of equal scores the piece that starts first wins, from the end backwards."""
    from faultcast.llm.tokens import Counter as Pieces, Vocabulary
    r = random.Random(3)
    for trial in range(60):
        vocabulary = {"".join(r.choice("ab▁") for _ in range(r.randint(1, 3))): -float(r.randint(1, 4)) for _ in range(6)}
        pieces = Pieces(Vocabulary(vocabulary, trial % 2 == 0, True))
        s = "".join(r.choice("abc ") for _ in range(9))

        def best(t):
            found = None
            for k in range(len(t)):  # starts ascending, strictly better replaces
                part, head = t[k:], None
                if part in vocabulary:
                    head = vocabulary[part]
                    size = 1
                elif len(part) == 1:
                    head = min(vocabulary.values()) - 10
                    size = len(part.encode()) if trial % 2 == 0 else 1
                if head is None:
                    continue
                score, n, unknown = best(t[:k]) if k else (0.0, 0, False)
                new = part not in vocabulary
                if trial % 2 and new and unknown:
                    size = 0
                if found is None or score + head > found[0]:
                    found = (score + head, n + size, new)
            return found

        want = best("▁" + s.replace(" ", "▁"))
        assert pieces(s) == want[:2]


def brute_licenses(text, phrases, templates, threshold):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, low)
    hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    labels, best = {x for _, x in hits}, 0.0
    for line in low.split("\n"):
        have = set(re.findall(word, line))
        for label, texts in templates.items():
            for t in texts:
                share = len(have & set(t.split())) / len(set(t.split()))
                if share >= threshold - 1e-9:
                    labels.add(label)
                    best = max(best, share)
    return (len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None,
            ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), 1.0 if hits else best)


def test_license_scan_matches_brute_force(documents):
    from faultcast.llm.licenses import PHRASES, TEMPLATES, scan_licenses
    texts = ["MIT License. Mit  LICENSE\nmit-license", "General\nPublic License", "license mit", "All rights reserved, all.",
             "Licensed under the Apache License", "Released, under the MIT", "the Apache license the MIT license " * 3,
             "Licensed under CC BY-NC 4.0", "mit licensed", "rights all\nreserved", "ümit license", prose(8, 200)]
    docs = documents(ODD + [(20 + i, t) for i, t in enumerate(texts)])
    for threshold in (0.8, 0.5):
        got = rows_of(scan_licenses(docs, threshold=threshold), "doc_id", "n_words", "n_base", "first_word", "last_word",
                      "base_labels", "labels", "score")
        want = sorted(((r.doc_id, *brute_licenses(r.text, PHRASES, TEMPLATES, threshold)) for r in docs.collect()), key=repr)
        assert got == want


def brute_runs(text, templates, threshold):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, best = set(), 0.0
    for label, texts in templates.items():
        for t in texts:
            own, run = set(t.split()), 2 * len(t.split())
            for k in range(max(1, len(w) - run + 1)):
                share = len(own & set(w[k:k + run])) / len(own)
                if share >= threshold - 1e-9:
                    labels.add(label)
                    best = max(best, share)
    return ",".join(sorted(labels)), best


def test_license_scan_finds_wrapped_notices_and_no_scattered_words(documents, monkeypatch):
    from faultcast.llm import queries
    from faultcast.llm.licenses import TEMPLATES, scan_licenses
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided"
    mpl = "This Source Code\n * Form is subject to the\n * terms of the Mozilla\n * Public License, v. 2.0."
    scattered = f"all {prose(5, 60)} rights {prose(6, 60)} reserved"
    r = random.Random(4)
    vocabulary = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
    mixed = [" ".join(r.choice(t.split() + [r.choice(vocabulary), "x"]) for _ in range(r.randint(5, 60)))
             for texts in TEMPLATES.values() for t in texts * 3]
    texts = [bsd, mpl, scattered, "rights all\nreserved", prose(7, 90) + "\n" + bsd.replace(" ", "\n") + prose(8, 90), *mixed]
    docs = documents(ODD + [(20 + i, t) for i, t in enumerate(texts)])
    for threshold in (0.8, 0.5):
        got = rows_of(scan_licenses(docs, phrases={"no such phrase": "x"}, threshold=threshold, block="run"), "doc_id", "labels", "score")
        assert got == sorted(((r.doc_id, *brute_runs(r.text, TEMPLATES, threshold)) for r in docs.collect()), key=repr)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = {r.doc_id: r.labels for r in queries.op8_license_scan(docs.sparkSession, "").collect()}
    assert (got[20], got[21], got[22]) == ("bsd", "mpl", "")


def edit_distance_within(pattern, text):
    """Least distance of ``pattern`` to any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def mutated(text, edits, seed):
    r = random.Random(seed)
    s = list(text)
    for _ in range(edits):
        k, what = r.randrange(len(s)), r.randrange(3)
        if what == 0:
            s[k] = "q"
        elif what == 1:
            s.insert(k, "q")
        else:
            del s[k]
    return "".join(s)


def test_decontamination_matches_brute_force(documents, spark):
    from faultcast.llm.decontam import drop_contaminated, find_items, normal
    items = [(k, prose(100 + k, 25)) for k in range(6)] + [(6, None), (7, "  "), (8, prose(100, 25).upper()), (None, "lost")]
    texts = [(k, f"{prose(200 + k, 30)}\n{mutated(items[k % 6][1], k % 12, k)} {prose(300 + k, 30)}") for k in range(30)]
    docs = documents(ODD[:6] + [(50 + k, t) for k, t in texts])
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (8 << 20, 400):
        got = rows_of(find_items(docs, table, rate=0.05, block_bytes=block_bytes), "doc_id", "item_id", "distance")
        want = []
        for r in docs.collect():
            for k, item in items:
                p = normal(item)
                if k is not None and p:
                    d = edit_distance_within(p, normal(r.text))
                    if d <= int(0.05 * len(p)):
                        want.append((r.doc_id, k, d))
        assert got == sorted(want, key=repr)
    assert 12 < len({w[0] for w in want}) < 30
    left = drop_contaminated(docs, table)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted(
        (r.doc_id for r in docs.collect() if r.doc_id not in {w[0] for w in want}), key=repr)


def test_items_without_an_id_are_found(documents, spark, monkeypatch):
    from faultcast.llm import decontam, queries
    items = spark.createDataFrame([(None, prose(1, 25)), (None, prose(2, 25)), (3, prose(3, 25)), (None, None)], "item_id long, text string")
    docs = documents([(k, f"{prose(10 + k, 30)} {prose(k, 25)} {prose(20 + k, 30)}") for k in range(1, 6)])
    monkeypatch.setattr(queries, "table", lambda _, __, name: {"documents": docs, "benchmark": items}[name])
    got = rows_of(queries.op4_decontamination(spark, ""), "doc_id", "item_id", "distance")
    assert got == [(1, None, 0), (2, None, 0), (3, 3, 0)]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [4, 5]


def test_myers_equals_dynamic_programme():
    from faultcast.llm.decontam import myers
    r = random.Random(5)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 80)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        want = edit_distance_within(p, t)
        got = myers(p, t, len(p) - 1)
        assert (got[0] if got else len(p)) == min(want, len(p))


def test_classifier_learns_and_ignores_held_out_labels(documents, spark):
    from zlib import crc32
    from faultcast.llm.quality import classify
    good = [(k, prose(k, 120)) for k in range(200)]
    bad = [(200 + k, (prose(1000 + k, 4) + " ") * 30) for k in range(100)]
    docs = documents([*good, *bad, (1000, None), (1001, ""), (None, "nobody"), (0, prose(0, 120))])
    labels = [(k, int(k < 200), 0) for k in range(300)] + [(0, 1, 1), (5000, 1, 0), (None, 0, 0), (7, None, None)]
    schema = "doc_id long, quality int, toxic int"
    got = {r.doc_id: r for r in classify(docs, spark.createDataFrame(labels, schema)).collect()}
    held = [k for k in range(300) if crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in held) for k in range(300)) and not got[None].held_out
    assert sum(got[k].predicted == int(k < 200) for k in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score
    # held-out labels change nothing
    wrong = [(k, 1 - q if k in held else q, t) for k, q, t in labels]
    again = {r.doc_id: r.score for r in classify(docs, spark.createDataFrame(wrong, schema)).collect()}
    assert again == {k: r.score for k, r in got.items()}
    # no labels at all: an even score
    none = classify(docs, spark.createDataFrame([], schema)).collect()
    assert {r.score for r in none} == {0.5}
