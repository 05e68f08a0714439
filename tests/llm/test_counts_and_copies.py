"""Source divergence audit, importance resampling, exact dedup: against plain loops over small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .conftest import prose

WORDS = ["alpha", "Beta", "gamma7", "déjà", "x", "ÄÖ", "delta-e", "l'eau", "42", "zeta"]


def some_docs(n: int, seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source) with nulls, empty texts, repeated rows and frequent words."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        text = "\n".join(" ".join(r.choice(WORDS) if r.random() < 0.7 else f"w{r.randint(0, 30)}q" for _ in range(r.randint(0, 9)))
                         for _ in range(r.randint(1, 4)))
        out.append((k, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", "ü", None])))
    return out + [(n, None, "en", "a"), (n + 1, "", "de", "lonely"), (n + 2, "... 12", "fr", None), (n + 2, "... 12", "fr", None),
                  (None, "alpha beta", "en", "b"), out[5], out[5]]


@pytest.fixture
def table_of(spark):
    """documents with every helper name of the three operators as a further column."""
    helpers = ["run", "address", "doc", "short", "strong", "size", "least", "n", "k1", "k2", "line", "words", "features", "term", "p", "row",
               "rank", "part", "k"]

    def make(rows):
        kinds = [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")],
                 *[T.StructField(c, T.StringType()) for c in helpers]]
        return spark.createDataFrame([(*r, *helpers) for r in rows], T.StructType(kinds)).repartition(4)
    return make


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- 11

def brute_divergence(rows, min_docs, top):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))) for _, t, lang, source in rows]
    df = defaultdict(Counter)
    for lang, _, ts in texts:
        df[lang].update(set(ts))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in df.items()}
    count = {(lang, s): Counter() for lang, s, _ in texts}
    for lang, s, ts in texts:
        kept.setdefault(lang, [])
        count[lang, s].update(t for t in ts if t in set(kept[lang]))
    prob = lambda c, t, v: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * v)
    out = []
    for (lang, s), c in count.items():
        v = len(kept[lang])
        pairs = [(sum(abs(prob(c, t, v) - prob(d, t, v)) for t in kept[lang]), o) for (x, o), d in count.items() if x == lang and o != s]
        whole = sum((d for (x, _), d in count.items() if x == lang), Counter())
        heads = [(prob(c, t, v) - prob(whole, t, v), t) for t in kept[lang] if c[t] and prob(c, t, v) > prob(whole, t, v)]
        for part, items, limit in (("pair", pairs, None), ("term", heads, top)):
            ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:limit]
            out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(64, 4096), (2, 3)])
def test_divergence_matches_brute_force(table_of, monkeypatch, tiles):
    from faultcast.llm import divergence
    monkeypatch.setattr(divergence, "TILE_SOURCES", tiles[0])
    monkeypatch.setattr(divergence, "TILE_TERMS", tiles[1])
    monkeypatch.setattr(divergence, "PENDING", 25 if tiles[0] == 2 else 200_000)
    monkeypatch.setattr(divergence, "DENSE", 400 if tiles[0] == 2 else 1 << 20)
    rows = some_docs(150)
    got = divergence.divergence_audit(table_of(rows), min_docs=6, top=4, block_bytes=100 if tiles[0] == 2 else 1 << 20)
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect())
    assert got == brute_divergence(rows, 6, 4) and len({g[2] for g in got}) == 2


def test_divergence_of_empty_table(table_of):
    from faultcast.llm.divergence import divergence_audit
    assert divergence_audit(table_of([])).collect() == []
    # a language that keeps no term: pairs of value 0
    got = divergence_audit(table_of([(1, "one", "en", "a"), (2, None, "en", "b")])).collect()
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in got) == [("a", "b", 0, 1), ("b", "a", 0, 1)]


@pytest.mark.parametrize("n", [1, 2, 5, 300, 2048])
def test_perfect_hash_is_minimal(n):
    from faultcast.llm.divergence import mixed, perfect_hash
    h = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    shift, slot = perfect_hash(h)
    assert sorted(slot.tolist()) == list(range(n))
    bucket = (mixed(h, 1 << 40) % np.uint64(len(shift))).astype(int)
    assert ((mixed(h, shift[bucket]) % np.uint64(n)).astype(int) == slot).all()


def test_terms_that_are_not_stored_are_not_counted(spark):
    from faultcast.llm import divergence as D
    own = [("en", f"t{chr(97 + i % 26)}{'x' * (i // 26)}") for i in range(500)]
    kept = spark.createDataFrame(own, "lang string, term string")
    assert kept.select(F.xxhash64("lang", "term")).first()[0] % (1 << 64) == D.term_hash(b"en", own[0][1].encode())
    packed = D.packed(D.build_shards(kept, per_shard=40))[b"en"]
    terms = [t.encode() for _, t in own]
    assert sorted(D.lookup(packed, b"en", terms).tolist()) == list(range(500))
    assert (D.lookup(packed, b"en", [t + b"!" for t in terms]) == -1).all()


# ---------------------------------------------------------------- 12

def brute_sample(rows, target, max_n, buckets, min_words, percent):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(ws), [crc32(" ".join(ws[i:i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    out = []
    for k, r in enumerate(rows):
        n, f = features(r[1])
        w = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((o for o in out if o[5] >= min_words), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for k, o in enumerate(fit[:len(fit) * percent // 100]):
        o[4] = k + 1
    return sorted((tuple(o) for o in out), key=repr)


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_resampling_matches_brute_force(spark, table_of, monkeypatch, max_n):
    from faultcast.llm import resampling
    monkeypatch.setattr(resampling, "HOT_SHARE", 20)
    rows = some_docs(120)
    target = ["alpha beta alpha", None, "", "w3q w4q\nw5q gamma7 l'eau", "zeta\n\nx"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = resampling.importance_sample(table_of(rows), items, max_n=max_n, buckets=500, min_words=8, percent=30)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank", "n_words")) for r in got.collect()), key=repr)
    assert got == brute_sample(rows, target, max_n, 500, 8, 30)
    assert sum(g[4] is not None for g in got) > 15


def test_resampling_of_empty_tables(spark, table_of):
    from faultcast.llm.resampling import importance_sample
    none = spark.createDataFrame([], "item_id int, text string")
    assert importance_sample(table_of([]), none).collect() == []
    got = importance_sample(table_of([(1, prose(1, 40), "en", "a"), (2, None, "en", "a")]), none, percent=100).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 40, 1), (2, 0, None)}


def test_cross_line_features():
    from faultcast.llm.resampling import Buckets, cross_features, line_features
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", "c", " ", "\n"]) for _ in range(r.randint(0, 30)))
        for n in (2, 3, 4):
            known = Buckets(97)
            inner = [b for line in text.split("\n") for b in line_features(line.encode(), known, n)[1]]
            assert sorted(inner + cross_features(text.encode(), known, n)) == sorted(
                line_features(text.replace("\n", " ").encode(), known, n)[1]), repr(text)


# ---------------------------------------------------------------- 13

def brute_copies(rows):
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for k, (r, t) in enumerate(zip(rows, normal)):
        groups[t].append((r[0] is None, r[0] or 0, k))
    out = []
    for r, t in zip(rows, normal):
        out.append((r[0], rows[min(groups[t])[2]][0], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan", [2, 16])
def test_exact_groups_match_brute_force(table_of, fan):
    from faultcast.llm.exact import exact_groups
    rows = some_docs(60)
    rows += [(100 + k, "same  text\t\n x", "en", "a") for k in range(40)] + [(90, " same text x", "en", "a"), (91, "same text x", "en", "b"),
                                                                            (None, "same text x", None, None)]
    got = exact_groups(table_of(rows).repartition(9), fan=fan).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_copies(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept) == {r["text_sha256"] for r in got} and set(kept.values()) == {1}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_digests_that_collide_stay_apart(spark):
    from faultcast.llm.exact import merge_runs
    rows = [(run, 7, bytes([run % 2]) * 32, 5, (False, 10 - run, run), 1) for run in range(9)]
    runs = spark.createDataFrame(rows, "run int, short long, strong binary, size int, least struct<absent:boolean,doc:long,address:long>, n long")
    got = sorted((bytes(r["strong"])[0], r["least"]["doc"], r["n"]) for r in merge_runs(runs, 9, fan=2).collect())
    assert got == [(0, 2, 5), (1, 3, 4)]


def test_drop_copies_returns_the_rows_that_stay(table_of):
    from faultcast.llm.exact import drop_copies
    rows = some_docs(40) + [(200, "dup  text", "en", "a"), (150, "dup text", "de", "b"), (150, "dup text", "de", "b")]
    table = table_of(rows)
    got = drop_copies(table)
    assert got.columns == table.columns and got.schema["doc_id"] == table.schema["doc_id"]
    want = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode()).hexdigest() for r in rows}
    assert got.count() == len(want)
    assert [r["doc_id"] for r in got.filter(F.col("text").startswith("dup")).collect()] == [150]
    assert drop_copies(table_of([])).count() == 0


def test_exact_groups_of_text_ids(spark):
    from faultcast.llm.exact import exact_groups
    d = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", None), ("d", "")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(d).collect())
    assert got == [("", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False), ("c", "c", 2, True), ("d", "c", 2, False)]
    empty = d.filter("doc_id = 'z'")
    assert exact_groups(empty).collect() == []
