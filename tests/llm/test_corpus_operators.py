"""Operators that compare texts with each other: substring, line and near-duplicate dedup, mixing, archive, pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from .conftest import prose
from .test_text_operators import ODD, rows_of


def brute_substrings(docs, width, first):
    """docs: (doc_id, text) in the order in which first occurrences count; ids differ."""
    raws = [(d, (t or "").encode()) for d, t in docs]
    count, seen = Counter(), set()
    for _, r in raws:
        for i in range(len(r) - width + 1):
            count[r[i:i + width]] += 1
    out = []
    for d, r in raws:
        mask = bytearray(len(r))
        for i in range(len(r) - width + 1):
            w = r[i:i + width]
            if (w in seen) if first else count[w] > 1:
                mask[i:i + width] = b"\1" * width
            seen.add(w)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        kept = bytes(b for b, m in zip(r, mask) if not m)
        out.append((d, len(r), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, 256])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_substring_dedup_matches_brute_force(documents, monkeypatch, hot, keep):
    from faultcast.llm import suffix
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    r = random.Random(1)
    pool = [prose(k, 14) for k in range(12)]
    rows = [(k, "\n".join(r.choice(pool) if r.random() < 0.5 else prose(100 + k, r.randint(1, 40)) for _ in range(r.randint(0, 7))))
            for k in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (64, "é" * 300), (65, "x" * 1000), (66, "ab" * 90 + "x" * 70)]
    got = rows_of(suffix.dedup_substrings(documents(rows), width=60, gram=20, keep=keep),
                  "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_substrings(rows, 60, keep == "first")
    assert sum(g[2] for g in got) > 1000


@pytest.mark.parametrize("kept", [1 << 20, 40])
def test_shared_passages_match_brute_force(documents, monkeypatch, kept):
    from faultcast.llm import suffix
    monkeypatch.setattr(suffix, "SAMPLES", kept)
    monkeypatch.setattr(suffix, "SEGMENT", 400)
    r = random.Random(2)
    pool = [prose(k, 30).split() for k in range(6)]
    rows = []
    for k in range(80):
        ws = prose(500 + k, r.randint(0, 60)).split()
        for _ in range(r.randint(0, 2)):
            a, n = r.choice(pool), r.randint(2, 30)
            ws[len(ws) // 2:len(ws) // 2] = a[:n]
        rows.append((k, r.choice([" ", "\n", "  "]).join(ws)))
    rows += [(90, rows[7][1]), (91, prose(1, 100)), (91, prose(1, 100)), (92, None), (93, ""), (94, "x " * 40)]

    def sharing(n):
        holders = defaultdict(set)
        for d, t in rows:
            ws = (t or "").split()
            for i in range(len(ws) - n + 1):
                holders[tuple(ws[i:i + n])].add(d)
        return {d for h in holders.values() if len(h) > 1 for d in h}

    got = suffix.dedup_substrings(documents(rows)).collect()
    assert len(got) == len(rows) and not any(r["repeated_passage"] for r in got if not r["n_bytes"])
    monkeypatch.setattr(suffix, "SPAN", 20)
    d = documents(rows)
    tags = suffix.shared_passages(d.select(d.doc_id.alias("tag"), F.coalesce("text", F.lit("")).alias("text")), 20, 15)
    found = {r["tag"] for r in tags.collect()}
    assert sharing(20) <= found <= sharing(15) and len(found) > 15


@pytest.mark.parametrize("keep", ["none", "first"])
def test_substring_dedup_of_text_ids(spark, keep):
    from faultcast.llm.suffix import dedup_substrings
    text = prose(1, 120)
    rows = [("b", text + " end"), ("a", "start " + text), (None, text), ("c", None)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = rows_of(dedup_substrings(d, keep=keep), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    assert got == brute_substrings(order, 400, keep == "first")


def test_substring_dedup_of_repeated_rows(documents):
    from faultcast.llm.suffix import dedup_substrings
    text = prose(1, 200)
    got = rows_of(dedup_substrings(documents([(1, text), (1, text), (None, prose(2, 200))])), "doc_id", "n_removed")
    n = len(text.encode())
    assert got == [(1, n), (1, n), (None, 0)]


def test_substring_dedup_keeps_the_first_of_repeated_holders(documents):
    from faultcast.llm.suffix import dedup_substrings
    passage, own = prose(3, 120), prose(4, 60)
    text = f"{prose(5, 60)} {passage} {own}"
    rows = [(1, text), (1, text), (2, f"{prose(6, 60)} {passage} {prose(7, 60)}")]
    got = {d: n for d, n in rows_of(dedup_substrings(documents(rows), keep="first"), "doc_id", "n_removed")}
    assert got[1] == 0 and got[2] >= len(passage)


def brute_lines(rows, min_chars=40, min_docs=5):
    ws = " \t\n\x0b\x0c\r"
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ws))
    where = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(where.get(key(x), ())) < min_docs
                or d == max(where[key(x)], key=lambda v: (v is not None, v or 0))]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(documents):
    from faultcast.llm.lines import dedup_lines, drop_lines
    r = random.Random(2)
    pool = [prose(k, 12) for k in range(6)] + ["ÉTÉ " * 12, "short"]
    rows = [(k, "\n".join(r.choice([str.upper, str, lambda x: f" {x}\t\x0b"])(r.choice(pool)) if r.random() < 0.6 else prose(50 + k, 9)
                          for _ in range(r.randint(1, 12)))) for k in range(40)]
    rows += [*ODD, (7, rows[9][1]), (7, rows[9][1]), (None, pool[0]), (99, pool[0] + "\n" + pool[0])]
    docs = documents(rows)
    assert rows_of(dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows)
    left = drop_lines(docs)
    assert left.columns == docs.columns and left.schema == docs.schema and left.count() == len(rows)


def test_line_dedup_splits_a_hot_line(documents):
    """With one slice or many the same lines go."""
    from faultcast.llm.lines import dedup_lines
    line = prose(1, 15)
    rows = [(k, f"{line}\n{prose(k + 10, 5)}\n{line}") for k in range(50)]
    a, b = (rows_of(dedup_lines(documents(rows), slices=s), "doc_id", "n_dropped", "kept_sha256") for s in (1, 8))
    assert a == b and [x[1] for x in a] == [0 if x[0] == 49 else 2 for x in a]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=repr)


def chain(seed, n, words):
    """Texts of which each changes a word or two of its forerunner, so that the ends differ much."""
    r, out = random.Random(seed), [prose(seed, words).split()]
    for _ in range(n - 1):
        w = list(out[-1])
        for _ in range(r.randint(1, 2)):
            w[r.randrange(len(w))] = f"w{r.random()}"
        out.append(w)
    r.shuffle(out)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("part", [16, 1024])
def test_jaccard_join_matches_brute_force(documents, monkeypatch, part):
    from faultcast.llm import jaccard
    monkeypatch.setattr(jaccard, "PART", part)
    texts = [t for k in range(8) for t in chain(k, 12, 30 + 12 * k)] + chain(50, 90, 80)
    passage = prose(9, 60)
    texts += [f"{passage} {prose(70 + k, 45)}" for k in range(80)] + [f"{passage} {prose(170 + k, 9)}" for k in range(30)]
    texts += ["A b C d", "a B c D", "a b c d e", "a b c", texts[5], texts[5].upper()]
    order = list(range(len(texts)))
    random.Random(4).shuffle(order)
    rows = [(k, texts[i]) for k, i in enumerate(order)] + [(900, None), (901, ""), (901, ""), (None, texts[7]), (None, "alone")]
    got = rows_of(jaccard.near_duplicates(documents(rows)), "doc_id", "n_shingles", "component_id")
    want = brute_components(rows)
    assert got == want
    left = jaccard.keep_one(documents(rows))
    assert {r.doc_id for r in left.collect()} == {d if d is not None else None for d, _, c in want if d == c or d is None}


def test_sets_have_a_row_per_node(documents, monkeypatch):
    """Rows of one text under many ids share a node; with a full filter all of them pass."""
    from pyspark.sql import functions as F

    from faultcast.llm import jaccard
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1)
    rows = [(k, prose(1, 40)) for k in range(30)] + [(30, prose(2, 40)), (30, prose(2, 40))]
    d = documents(rows).select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    nodes = jaccard._scan(d).filter("shingle is null").groupBy("node").agg(F.min("key").alias("key"))
    sets = jaccard._node_sets(d, nodes, nodes, "sets_of_test")
    assert sets.count() == nodes.count() == 2


def test_keep_one_tells_rows_of_one_id_apart(documents):
    from faultcast.llm.jaccard import keep_one
    a, b, c, e = (prose(40 + k, 60) for k in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, e), (None, e), (4, ""), (4, ""), (None, None)]
    left = keep_one(documents(rows))
    assert left.columns == documents(rows).columns
    assert rows_of(left, "doc_id", "text") == sorted([(1, a), (2, b), (3, c), (None, e), (4, ""), (4, ""), (None, None)], key=repr)


def test_summed_minima_bound_the_overlap_and_boxes_bound_their_points():
    import numpy as np
    from faultcast.llm import jaccard
    words = jaccard.Words()
    texts = [t for k in range(6) for t in chain(k, 20, 60)]
    sets = jaccard.Sets([t.encode() for t in texts], words)
    points, n = sets.vectors(), sets.n
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    every = np.arange(len(sets))
    found = {tuple(sorted(p)) for p in jaccard.block_pairs(points, n, every, every, every).tolist()}
    assert linked and linked <= found and len(found) < len(sets) ** 2 / 6


def test_shingles_of_many_texts_are_those_of_each():
    import numpy as np
    from faultcast.llm import jaccard
    rng = random.Random(5)
    texts = [None if k == 9 else rng.choice([" ", "\n", "\x0b\t"]).join(rng.choice(["a", "B", "c", "é", "x" * 90]) for _ in range(
        rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 40, 300]))) for k in range(150)]
    words = jaccard.Words()
    words.PIECE = 128  # pieces that end inside texts, words longer than a piece's rest
    sets = jaccard.Sets([(t or "").encode() for t in texts], words)
    tokens = [(t or "").encode().lower().split() for t in texts]
    plain = [{tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in tokens]
    assert sets.n.tolist() == [len(s) for s in plain]
    often = np.unique(np.concatenate([sets[i] for i in range(0, 150, 30)]))
    owner, first = sets.first(often)
    for i in range(150):
        for j in range(0, 150, 7):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])
            assert (sets.nodes()[i] == sets.nodes()[j]) == (plain[i] == plain[j])
        s, k = sets[i], len(plain[i]) - (4 * len(plain[i]) + 4) // 5 + 1
        if len(s):
            order = np.sort(np.where(np.isin(s, often), s | jaccard.TOP, s))
            assert sorted(first[owner == i].tolist()) == order[:k].tolist()
        assert (sets.vectors()[i] == np.bincount((s & np.uint64(255)).astype(int), minlength=256)).all()


def test_components_of_chains_and_stars(spark):
    from faultcast.llm.graph import components
    edges = [(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(1, 200)] + [(7, 7), (1000, 999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(101)} | {500 + k: 500 for k in range(200)} | {1000: 999, 999: 999}
    assert got == want


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, total = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(target[s] for s in fixed)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
        fixed |= set(over)


def test_mix_meets_the_targets(documents):
    from faultcast.llm.mixing import mix
    r = random.Random(6)
    sources = [None, "b", "a", "é", "Z", "tiny", "none"]
    rows = [(k, prose(k, r.randint(1, 400) if k % 50 else 5000), r.choice(sources[:5])) for k in range(1500)]
    rows += [(2000, prose(1, 3), "tiny"), (2001, None, "none"), (2002, "", "none"), (None, "x y z", "a"), (3, prose(3, 50), "a"),
             (3, prose(3, 50), "a")]
    docs = documents(rows)
    got = mix(docs).collect()
    size, taken, stated = Counter(), Counter(), {}
    for g in got:
        size[g.source] += g["size"]
        taken[g.source] += g.taken
        stated[g.source] = (g.source_size, g.target)
        assert 0 <= g.taken <= 2 * g["size"] and g.taken == g.copies * g["size"]
    want = brute_targets(size)
    assert len(got) == len(rows)
    assert Counter((g.doc_id, g["size"]) for g in got) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    for s in size:
        assert stated[s][0] == size[s] and stated[s][1] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 10), s
    assert rows_of(mix(docs), "doc_id", "size", "taken") == sorted(((g.doc_id, g["size"], g.taken) for g in got), key=repr)


def test_targets_of_many_sources(spark):
    from faultcast.llm.mixing import source_targets
    r = random.Random(8)
    for sizes in ({f"host{k}.{'é' * (k % 3)}": r.choice([0, 1, 30, 400, 10 ** r.randint(1, 6)]) for k in range(700)}, {None: 5}, {"a": 0},
                  {"a": 10, "b": 10, "c": 10}):
        table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long").repartition(7)
        got = {x.source: x.target for x in source_targets(table).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_tilts_that_do_not_converge_fail(spark):
    from faultcast.llm.mixing import solve_tilts, source_targets
    table = spark.createDataFrame([("a", 1 + k, 3) for k in range(40)], "source string, size long, n long")
    targets = source_targets(table)
    assert solve_tilts(table, targets).first().tilt > 0
    with pytest.raises(RuntimeError, match="converged"):
        solve_tilts(table, targets, steps=1)


def test_tilts_solve_the_dual(documents):
    """The rates meet each target in expectation, and are exponential in the size."""
    import math
    from faultcast.llm.mixing import mix
    rows = [(k, prose(k, 1 + 7 * k % 90), "ab"[k % 2]) for k in range(400)]
    got = mix(documents(rows)).collect()
    for s in "ab":
        mine = [g for g in got if g.source == s]
        assert sum(g.rate * g["size"] for g in mine) == pytest.approx(mine[0].target, rel=1e-6)
        tilt = {round(math.log(g.rate) / g["size"], 9) for g in mine if g.rate < 2}
        assert len(tilt) <= 1


def pages(spark):
    big = "<p>" + prose(1, 300) + "é</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(k, f"http://h/{k}", big) for k in (4, 9, 2)] + [(k, None, "small") for k in (5, 6)]
    rows += [(7, "http://h/\r\nX: y", None), (8, "", ""), (9, "http://h/9", big), (None, "u", big), (10, "u", prose(2, 400))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), rows


def test_archive_round_trip(spark, tmp_path):
    from faultcast.llm import warc
    table, rows = pages(spark)
    warc.write_archive(table, str(tmp_path / "a"))
    read = warc.read_archive(spark, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({h or "" for _, _, h in rows})
    got = read.collect()
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in got), key=repr) == sorted(((p, h or "") for p, _, h in rows), key=repr)
    want = {4: ("revisit", 9), 9: ("response", None), 2: ("revisit", 9), None: ("revisit", 9)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (p, *want.get(p, ("response", None))) for p, _, _ in rows}
    digests = rows_of(warc.page_records(read), "page_id", "payload_bytes", "payload_digest")
    assert digests == sorted(((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows), key=repr)
    # plain files and back, to the byte
    warc.export_warc(read, str(tmp_path / "w"), rows_per_file=2)
    back = [bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in warc.import_warc(spark, str(tmp_path / "w")).collect()]
    assert sorted(back) == sorted(bytes(r.record) for r in got)


def test_archive_refuses_a_changed_payload(spark, tmp_path):
    from faultcast.llm import warc
    table, _ = pages(spark)
    warc.write_archive(table, str(tmp_path / "a"))
    p = spark.read.parquet(str(tmp_path / "a/payloads"))
    p.selectExpr("sha256", "cast('other' as binary) packed").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_archive_of_no_pages(spark, tmp_path):
    from faultcast.llm import warc
    table, _ = pages(spark)
    warc.write_archive(table.filter("page_id < 0"), str(tmp_path / "a"))
    assert warc.page_records(warc.read_archive(spark, str(tmp_path / "a"))).collect() == []


def test_pipeline_stages_by_brute_force(documents, spark, tmp_path):
    """Each stage against what it should keep of its own input, and clean documents to the end."""
    import corpus_pipeline
    items = [(k, prose(900 + k, 40)) for k in range(3)]
    line = prose(800, 14)
    clean = [(k, f"{prose(k, 60)}\n{prose(500 + k, 40)}", f"s{k % 3}") for k in range(20)]
    rows = clean + [(30, "too short", "s0"), (31, "again and " * 60, "s1"), (32, f"{prose(1, 30)} {items[1][1]} {prose(2, 30)}", "s2")]
    rows += [(40 + k, f"{prose(600 + k, 70)}\n{line}", "s0") for k in range(6)]
    near = prose(700, 120).split()
    rows += [(50 + k, " ".join(near[:60 + k] + [f"new{k}"] + near[61 + k:]), "s1") for k in range(4)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {r[0] for r in rows}
    assert set(kept[names[0]]) == ids - {30, 31}
    assert set(kept[names[1]]) == ids - {30, 31}
    assert [k for k in range(40, 46) if line in kept[names[1]][k]] == [45]
    assert set(kept[names[2]]) == ids - {30, 31, 51, 52, 53}
    assert set(kept[names[3]]) == ids - {30, 31, 51, 52, 53, 32}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == set(kept[names[3]])
    assert {k: kept[names[3]][k] for k, _, _ in clean} == {k: t for k, t, _ in clean}
