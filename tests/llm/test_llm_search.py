"""Spelling variants, neighbour graphs and ranked search against brute force, on tables with every kind of odd row, and empty."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, item_id long, word string, n long, q long, key string, node long, root string, part string, w string, t long"
EXTRA = (4, "w", 5, 6, "k", 7, "r", "p", "w", 8)


def table(spark, texts, partitions=3):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in texts], SCHEMA).repartition(partitions)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(texts, spoilt, letters, occurrences, factor):
    count = collections.Counter()
    for i, text in texts:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % spoilt == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= letters:
                count[r] += 1
    n = {w: c for w, c in count.items() if c >= occurrences}
    out = {}
    for w, c in n.items():
        beside = [o for o in n if near(w, o)]
        best = min(beside, key=lambda o: (-n[o], o), default=None)
        out[w] = [c, len(beside), best if best is not None and n[best] >= factor * c else None]
    for w in out:
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        out[w].append(at)
    return {w: (c, k, f, n[f] if f else None, r) for w, (c, k, f, r) in out.items()}


@pytest.mark.parametrize("part", [1 << 13, 7])
def test_spelling(spark, part):
    from tallyforge.llm.spelling import variants

    r = random.Random(3)
    stems = ["".join(r.choice("abcéÿ") for _ in range(r.randint(3, 8))) for _ in range(40)]
    texts = [(i, " ".join(r.choice(stems) if r.random() < 0.8 else r.choice(stems)[:-1] + r.choice("abÐx") for _ in range(80)) + ". Übér, ÜBÉR's x×y÷z") for i in range(25)]
    texts += [(None, None), (None, "abcabc " * 9), (50, ""), (51, "!!! 123"), (52, "q" * 300 + " " + "q" * 299 + " " + "q" * 300), texts[0], texts[0], (53, "a" * 50_000)]
    got = {x["word"]: (x["n"], x["n_near"], x["form"], x["form_n"], x["root"]) for x in variants(table(spark, texts), spoilt=3, letters=3, occurrences=2, factor=2, part=part).collect()}
    assert got == plain_variants(texts, 3, 3, 2, 2)
    assert variants(table(spark, []).limit(0)).count() == 0


def test_active_nodes():
    from tallyforge.llm import spelling

    r = random.Random(1)
    for deep in (40, 3):
        spelling.DEEP, was = deep, spelling.DEEP
        for _ in range(60):
            some = sorted({"".join(r.choice("abÿ") for _ in range(r.randint(1, 7))).encode("latin-1") + b"\x01" for _ in range(60)})
            x, y = spelling.near_pairs(some, some, b"", b"", True)
            assert {frozenset(p) for p in zip(x, y, strict=True)} == {frozenset((a, b)) for k, a in enumerate(some) for b in some[:k] if near(a[:-1], b[:-1])}
            cut = [w for w in some if w.startswith(b"ab")], [w for w in some if w.startswith(b"bb")]
            x, y = spelling.near_pairs(some, some, b"ab", b"bb", False)
            assert {(a, b) for a, b in zip(x, y, strict=True)} == {(a, b) for a in cut[0] for b in cut[1] if a[2:] == b[2:]}
        spelling.DEEP = was


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranks(docs, items, limit):
    words = [(i, terms(t)) for i, t in docs]
    total, length = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = collections.Counter(t for _, w in words for t in set(w))
    out = {}
    for key, text in {(k, t) for k, t in items}:
        found = []
        for i, w in words:
            tf, score = collections.Counter(w), 0
            for t in set(terms(text)):
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += weight * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * (50 + (50 * len(w) * total) // length)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out[key, text] = [(k + 1, None if missing else i, -s) for k, (s, missing, i) in enumerate(sorted(found)[:limit])]
    return out


@pytest.mark.parametrize(("shard_bytes", "block_terms", "together"), [(8 << 20, 1 << 18, 64), (2000, 5, 2)])
def test_ranked_search(spark, monkeypatch, shard_bytes, block_terms, together):
    from tallyforge.llm import treaps

    for k, v in (("SHARD_BYTES", shard_bytes), ("BLOCK_TERMS", block_terms), ("TOGETHER", together)):
        monkeypatch.setattr(treaps, k, v)
    r = random.Random(5)
    some = [f"w{int(r.paretovariate(0.8))}" for _ in range(9000)]
    docs = [(i, " ".join(some[i * 30 : i * 30 + r.randint(1, 60)])) for i in range(280)]
    docs += [docs[3], docs[3], (None, docs[3][1]), (None, docs[4][1]), (500, None), (501, ""), (502, "... !"), (503, "W1 w1 É漢字 " * 40), (504, " ".join(some)), (2**62 + 1, docs[5][1])]
    asked = [(k, " ".join(r.choice(some) for _ in range(r.randint(1, 12)))) for k in range(20)] + [(20, None), (21, ""), (22, "absent"), (23, "É漢字 W1"), (24, "w1 w1 w1"), (3, "w2 w3"), (None, "w2")]
    asked.append(asked[0])
    d = table(spark, docs)
    items = spark.createDataFrame([(k, t, "x") for k, t in asked], "item_id long, text string, doc_id string")
    for limit in (7, 1000):
        got = collections.defaultdict(list)
        for x in treaps.search(d, items, limit).collect():
            got[x["item_id"]].append((x["rank"], x["doc_id"], x["score"]))
        want = collections.defaultdict(list)
        for (key, _), rows in plain_ranks(docs, asked, limit).items():
            want[key] += rows
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items() if v}
    assert treaps.search(d.limit(0), items).count() == 0
    assert treaps.search(d, items.limit(0)).count() == 0


def test_treaps():
    from tallyforge.llm.treaps import treaps

    r = np.random.default_rng(2)
    sizes = np.array([1, 5, 2000, 3, 40])
    docs = np.concatenate([np.sort(r.choice(5000, n, replace=False)) for n in sizes])
    impacts = r.integers(1, 9, len(docs))
    d, i, left = treaps(sizes, docs, impacts)
    depth = 0

    def walk(at, size, low, high, most, level):
        nonlocal depth
        if size:
            depth = max(depth, level)
            assert low <= d[at] < high and i[at] <= most
            seen.append((d[at], i[at]))
            walk(at + 1, left[at], low, d[at], i[at], level + 1)
            walk(at + 1 + left[at], size - 1 - left[at], d[at] + 1, high, i[at], level + 1)

    for lo, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        seen = []
        walk(lo, n, 0, 5000, 99, 1)
        assert sorted(seen) == sorted(zip(docs[lo : lo + n], impacts[lo : lo + n], strict=True))
    assert depth < 60  # ties do not make a list of it


def plain_nearest(rows, chosen, limit):
    ok = {}
    for k, v in rows:
        if k is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v):
            raw = np.array(v, "<f8")
            ok[k] = min(ok.get(k, raw), raw, key=lambda x: x.tobytes())
    out = {}
    for q in ok:
        if chosen(q):
            found = [(-float(ok[q] @ v), k) for k, v in ok.items() if k != q and len(v) == len(ok[q])]
            out[q] = [(k, -s) for s, k in sorted(found)[:limit]]
    return out


@pytest.mark.parametrize("block", [1024, 48])
def test_neighbours(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    from tallyforge.llm import neargraph

    monkeypatch.setattr(neargraph, "BLOCK", block)
    monkeypatch.setattr(neargraph, "BUCKET", 100)
    monkeypatch.setattr(neargraph, "REQUESTS", 5)
    r = np.random.default_rng(4)
    base = r.standard_normal((700, 12)).astype("f4") * r.uniform(0.5, 2, (700, 1)).astype("f4")
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(700 + k, rows[20][1]) for k in range(60)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0] * 11 + [None]), (1004, [float("nan")] * 12), (1005, [float("inf")] * 12), (None, rows[1][1]), (1020, [1.0, 2.0]), (1040, [2.0, 2.0]), (1060, [3.0]), rows[5], rows[5]]
    d = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, node int, query string").repartition(3)
    got = collections.defaultdict(dict)
    for x in neargraph.nearest(d, F.col("vec_id") % 20 == 0, limit=10).collect():
        got[x["query_id"]][x["rank"]] = (x["vec_id"], x["score"])
    want = plain_nearest(rows, lambda k: k % 20 == 0, 10)
    right = total = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, len(got[q]) + 1))
        mine = [got[q][k] for k in sorted(got[q])]
        assert [(s, k) for k, s in mine] == sorted(((s, k) for k, s in mine), key=lambda p: (-p[0], p[1]))
        assert q not in [k for k, _ in mine]
        right += len({k for k, _ in mine} & {k for k, _ in best})
        total += len(best)
    assert {q for q in got if got[q]} == {q for q, best in want.items() if best}
    assert right >= 0.95 * total
    # The copies: the smallest ids of them, whatever the others.
    assert [k for k, _ in want[20]] == [got[20][k][0] for k in range(1, 11)]
    assert neargraph.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    others = spark.createDataFrame([(7, base[3].tolist()), (8, None)], "query_id long, embedding array<float>")
    found = neargraph.nearest(d, limit=3, queries=others).orderBy("rank").collect()
    best = sorted(((-float(base[3].astype("f8") @ np.array(v, "f8")), k) for k, v in {k: v for k, v in rows[:760]}.items()))[:3]
    assert [(x["query_id"], x["vec_id"]) for x in found] == [(7, k) for _, k in best]


def test_rows_of_one_id_are_dealt_to_many_files(spark):
    """A third of all rows with one id, and with one text too, don't meet in one file."""
    import public_tokenizers

    from tallyforge.llm.tokenfile import digests, starts, write_tokens

    texts = [(7, "the same words") for _ in range(400)] + [(None, f"without an id {k}") for k in range(400)] + [(k, f"text {k}") for k in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if they were too large to join
    try:
        files = write_tokens(table(spark, texts, 6), public_tokenizers.path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for where in ("doc_id = 7", "doc_id IS NULL"):
        sizes = [r["count"] for r in starts(files).filter(where).groupBy("shard").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 0.9 * sum(sizes)
    rows = sorted(digests(files).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]] and len(rows) == 1200
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_url_scores_whether_keys_are_sent_or_dealt(spark, monkeypatch):
    from tallyforge.llm import urlfilter

    hosts = ["casino-bonus.example.net", "news.example.org", "winter-sports.example.com", "freecasinowin.example.net"]
    urls = [(k, f"https://{hosts[0] if k % 2 else hosts[k % 4]}/a{k % 7}/page{k}.html?x") for k in range(300)] + [(900, None), (901, "no host")]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    got = []
    for hot in (1000, 1, 3):
        monkeypatch.setattr(urlfilter, "HOT", hot)
        got.append(sorted((r["page_id"], r["verdict"], round(r["p_block"], 9), tuple(r["tokens"])) for r in urlfilter.judge(pages).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 302


def test_longest_matches_keep_large_ids(spark):
    from tallyforge.llm.decontaminate import longest_matches

    passage = " ".join(f"word{k}" for k in range(14))
    docs = spark.createDataFrame([(2**60 + 1, "x " + passage), (None, passage)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", passage)], "item_id string, text string")
    found = longest_matches(docs, items, 10).filter("offset = 0").collect()
    assert [(r["doc_id"], r["word"], r["length"]) for r in found] == [(2**60 + 1, 1, 14)]
