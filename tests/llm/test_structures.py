"""Conversation repair, ranked lexical search and fingerprints against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter
from functools import cache
from heapq import nsmallest

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import conversations, fingerprints, hmm, html_text, lexical, maxscore, simhash, toxicity, warc

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows, by trying every edit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, seen, faults = [t for t, _, _ in rows if t is not None], set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @cache
    def best(i, state, inserts=2):
        """(cost, audit, lines) of the rest; inserts: how many may still come just here."""
        found = [(10**9, "", ())]
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, t = best(i + 1, state)
            found.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for initial, cost, edit, line in ((role[:1], 0, "K", f"{role}:{text}"), ("u", 2, "R", f"user:{text}"), ("a", 2, "R", f"assistant:{text}")):
                    if (state, initial) in follows:
                        c, a, t = best(i + 1, initial)
                        found.append((c + cost + more, edit + a, (line, *t)))
        for initial, line in (("u", "user:"), ("a", "assistant:")):
            if inserts and (state, initial) in follows:
                c, a, t = best(i, initial, inserts - 1)
                found.append((c + 2, "I" + a, (line, *t)))
        return min(found)

    cost, audit, lines = best(0, "")
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    count = Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def report(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def chat(rng, turns):
    text = ["Yes.", "No.", "Fine!", "cut off", " ", "", "\t\n", "What?", "Well ... \n", "so"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "ux", None]
    return [(t, rng.choice(roles), rng.choice([f"t{rng.randint(0, 99)}.", *text, None])) for t in (rng.choice([i, i, i, i + 3, None]) for i in range(turns))]


@pytest.mark.parametrize("block", [2, 8, 1024])
def test_repair_against_all_edits(spark, block):
    rng = random.Random(block)
    convs = {c: chat(rng, rng.randint(1, 9)) for c in [None, *range(70)]}
    rows = [(c, t, r, x) for c, ts in convs.items() for t, r, x in ts]
    rows += [rows[0], rows[9], rows[9], *rows[40:44]]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS _c", "2 AS place", "'x' AS edit", "3 AS cost").repartition(3)
    more = spark.createDataFrame([(5,), (500,), (None,)], "conv_id long")
    got = report(conversations.repair_report(df, more, block))
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = repaired([(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c])
    want[500] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


def test_repaired_turns_are_the_hashed_lines(spark):
    rng = random.Random(9)
    rows = [(c, t, r, x) for c in range(30) for t, r, x in chat(rng, 7)]
    df = spark.createDataFrame(rows, TURNS)
    lines = {}
    for r in conversations.repaired_turns(df, 4).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, row in report(conversations.repair_report(df)).items():
        assert row[-1] == hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest()
        assert len(lines.get(c, [])) == sum(x != "D" for x in row[-2])


def test_repair_of_a_long_conversation_in_blocks(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), f"{i}" + rng.choice([".", ""])) for i in range(2500)]
    rows += [(1, 7, "user", "again.")] * 400 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    few, many = report(conversations.repair_report(df, block=1024)), report(conversations.repair_report(df, block=16))
    assert few == many and few[1][1:4] == (0, 399, sum("." not in r[3] for r in rows)) and few[2][-2] == "KI"
    assert len(few[1][-2].replace("I", "")) == 2900 and few[1][-2].count("D") >= 399
    with pytest.raises(ValueError):
        conversations.repair_report(df, block=3)
    assert conversations.repair_report(df.limit(0)).count() == 0


def test_ranks_order_nodes_by_their_audits():
    codes = np.array([[2, 4, -1, 5, 2, 6, 0, 4]])
    arcs = conversations.least_arcs(codes, conversations.node_costs(codes, conversations.CLOSING[None, :])).reshape(-1, 4)
    rank, pointers = conversations.rank_paths(arcs)

    def audit(node):
        for letter in range(4):
            if arcs[node, letter] >= 0:
                return "DIKR"[letter] + audit(arcs[node, letter])
        return ""

    audits = [audit(n) for n in range(len(arcs))]
    order = {a: i for i, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == rank.tolist()
    for n, path in enumerate(conversations.walks(np.arange(len(arcs)), pointers).tolist()):
        assert len(dict.fromkeys(path)) == len(audits[n]) + 1


def brute_search(docs, items, k):
    def cut(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in low).split(" ")

    bags = [(d, Counter(t for t in cut(x) if t)) for d, x in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(t for t in cut(text) if t)
    out = []
    for item, ts in wanted.items():
        scores = []
        for d, b in bags:
            m = 10 + 90 * b.total() * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs,pass_terms", [(8192, 10**6), (16, 10**6), (7, 12)])
def test_lexical_search(spark, shard_docs, pass_terms):
    rng = random.Random(shard_docs)
    vocab = [f"W{i}" for i in range(40)] + ["Éa", "x1y", "日本", "İ"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "-", "\n", "_", "., "]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .-"), (None, docs[3][1]), (None, docs[4][1]), (203, docs[3][1]), (3, docs[3][1]), (204, "w1 " * 20_000)]
    docs += [(300 + i, docs[5][1]) for i in range(30)]
    items = [(i, text(6)) for i in range(12)] + [(12, None), (13, "..."), (14, "nowhere"), (3, "w7 w8"), (None, docs[5][1]), (15, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS terms", "3 AS ids").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS doc_id")
    got = lexical.top_documents(d, q, 10, shard_docs, pass_terms)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 10)
    assert lexical.top_documents(d.limit(0), q).count() == 0 and lexical.top_documents(d, q.limit(0)).count() == 0


def test_lexical_search_drops_intervals():
    rng = random.Random(2)
    bags = [Counter({b"common": 1, **({b"rare": 3} if i % 97 == 0 else {})}) for i in range(4000)]
    row = lexical._shard(list(range(4000)), bags, [rng.randint(4, 40) for _ in bags])
    shard = lexical.Lists(type("Row", (), row), {"common": 10, "rare": 5000}, 4000, 80_000)
    best, scored = lexical.search(shard, ["common", "rare"], [], 10)
    assert scored < 400
    every = []
    for d in range(4000):
        place = int(np.flatnonzero(shard.ids == d)[0])
        every.append((-sum(int(x[np.searchsorted(p, place)]) for p, x, *_ in (shard.get("common"), shard.get("rare")) if place in p), False, d))
    assert best == nsmallest(10, every)


def plain_sketch(text, k=fingerprints.K):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles})[:k]


def test_edited_fingerprints(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ünd", "the", "a", "B", "ñ", "日本"]) + str(rng.randint(0, 9))
    docs = [(i - 20, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)]
    docs += [(None, "no id"), (None, None), (7, docs[27][1]), (7, docs[27][1]), (7, "another seven"), (100, ""), (101, " \t"), (102, docs[3][1] * 400), (103, docs[3][1]), (104, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _part", "2 AS fingerprint", "3 AS n_chars").repartition(4)
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        like = lambda x, y: 1.0 if x == y else sum(h in x and h in y for h in sorted({*x, *y})[:128]) / len(sorted({*x, *y})[:128])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c)))
    assert sorted(map(tuple, fingerprints.edited_fingerprints(df).collect()), key=str) == sorted(want, key=str)
    one = fingerprints.edited_fingerprints(df.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 999)}" for _ in range(3000)]
    texts = [("a", " ".join(words[:2000])), ("a", " ".join(words[1996:])), ("b", " ".join(words[1000:])), ("c", None), (None, "one two"), ("d", " ".join(words[:50]))]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    prints = fingerprints.fingerprinted(df).join(df.select("doc_id", "source"), "doc_id")
    by = {r["source"]: r["fingerprint"] for r in fingerprints.merged_by(prints, "source").collect()}
    assert by["a"] == "".join(plain_sketch(" ".join(words))) and by["c"] == "" and by[None] == "".join(plain_sketch("one two"))
    pair = spark.createDataFrame([(by["a"], "".join(plain_sketch(texts[2][1])), "".join(plain_sketch(texts[5][1])))], "a string, b string, d string")
    got = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.distinct_shingles(F.col("a")).alias("n"), fingerprints.distinct_shingles(F.col("d")).alias("few"), fingerprints.resemblance(F.lit(""), F.lit("")).alias("none")).first()
    assert abs(got["r"] - 2 / 3) < 0.15 and got["c"] == 1.0 and got["m"] == by["a"] and abs(got["n"] / 2996 - 1) < 0.3 and got["few"] == 46 and got["none"] == 1.0


def test_extraction_keeps_the_whole_article():
    long = "<p>" + "A long sentence, with commas, and more words than most. " * 6 + "</p>"
    said = long[3:-4].strip()
    page = f"<article><header><h1>Title</h1></header><section>{long * 4}</section><section><h2>B</h2><p>tiny</p></section></article>"
    assert html_text.main_text(page) == "\n".join(["Title", *[said] * 4, "B", "tiny"])
    page = f"<body><div id=w><div class=row>{long * 3}</div><div class=row>{long * 18}</div></div></body>"
    assert html_text.main_text(page).count("\n") == 20
    links = "<p>See <a href=a>the first of these</a>, <a href=b>the second of these</a> and <a href=c>the third one of these</a></p>"
    refs = "<ol>" + "".join(f"<li><a href={i}>Reference number {i}, a paper with a long title</a></li>" for i in range(5)) + "</ol>"
    page = f"<article>{links}{long * 3}{refs}</article>"
    text = html_text.main_text(page).split("\n")
    assert text[0].startswith("See the first") and len(text) == 9 and text[-1].startswith("Reference number 4")
    for name in ('class="opinion comment"', 'id="comment-policy-article"'):
        assert html_text.main_text(f"<nav><a href=x>Home</a></nav><section {name}>{long * 2}</section>") == f"{said}\n{said}"
    assert html_text.main_text("<body><h1>Only heading</h1></body>") == "Only heading"
    assert html_text.main_text("<body><a href=a>Home</a><a href=b>News</a></body>") == ""


def test_extraction_of_generated_pages():
    """Pages built of known blocks: all blocks of the article come back, in order, and nothing else."""
    rng = random.Random(8)
    words = "river stone market winter paper letter garden morning number water people city".split()
    line = lambda n: (" ".join(rng.choice(words) + rng.choice(["", "", ","]) for _ in range(n)).strip(",") + ".").capitalize()
    menu = lambda: "<ul>" + "".join(f"<li><a href=/{i}>{rng.choice(words)}</a></li>" for i in range(rng.randint(4, 9))) + "</ul>"
    for _ in range(200):
        want, inner = [], ""
        title = line(6)
        for _ in range(rng.randint(1, 4)):
            parts = ""
            if rng.random() < 0.6:
                want_head = line(4)
                parts += f"<h2>{want_head}</h2>"
                want.append(want_head)
            for _ in range(rng.randint(1, 6)):
                text = line(rng.choice([3, 12, 40, 60]))
                if rng.random() < 0.2:
                    parts += f"<p>{text} <a href=a>{words[0]}</a> <a href=b>{words[1]}</a></p>"
                    want.append(f"{text} {words[0]} {words[1]}")
                else:
                    parts += rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(text)
                    want.append(text)
            inner += f"<section>{parts}</section>"
        for _ in range(2):  # the story outweighs its surroundings
            text = line(80)
            inner += f"<p>{text}</p>"
            want.append(text)
        article = rng.choice([f"<article><header><h1>{title}</h1></header>{inner}</article>", f"<main><h1>{title}</h1>{inner}</main>", f"<main><article><h1>{title}</h1>{inner}</article></main>"])
        comment = f"<div class={rng.choice(['comments', 'comment-list'])}>" + "".join(f"<p>{line(20)}</p>" for _ in range(rng.randint(1, 9))) + "</div>"
        before = [f"<nav>{menu()}</nav>", f"<header><h2>{line(3)}</h2>{menu()}</header>", f"<div class=cookie-notice><p>{line(9)}</p></div>", f"<div class='ad box'>{line(9)}</div>", menu()]
        after = [f"<footer><p>{line(12)}</p></footer>", f"<aside>{line(30)}</aside>", f"<div id=sidebar>{menu()}<p>{line(9)}</p></div>", comment, f"<form><p>{line(8)}</p><input></form>", f"<script>{line(5)}</script>"]
        rng.shuffle(before)
        rng.shuffle(after)
        page = f"<html><body>{''.join(before[: rng.randint(0, 5)])}{article}{''.join(after[: rng.randint(0, 6)])}</body></html>"
        assert html_text.main_text(page) == "\n".join([title, *want]), page


@pytest.mark.parametrize("params", [{"states": 9}, {"states": 0}, {"frequent": 65_536}, {"forms": 0}, {"rounds": 0}])
def test_language_model_refuses_sizes_that_it_cannot_pack(spark, params):
    docs = spark.createDataFrame([(1, False, "a b")], "doc_id long, held_out boolean, text string")
    with pytest.raises(ValueError):
        hmm.score_texts(docs, **params)


def plain_features(text):
    """Buckets of the 3-, 5- and 7-grams of each distinct word between its marks, one by one."""
    found = set()
    for word in dict.fromkeys((text or "").lower().split()):
        s = "\x02" + word + "\x03"
        for n in toxicity.SIZES:
            for i in range(len(s) - n + 1):
                h = ord(s[i])
                for c in s[i + 1 : i + n]:
                    h = (h * int(toxicity.ROLL) + ord(c)) % 2**32
                x = (h + n) * int(toxicity.STIR) % 2**32
                found.add(((x ^ x >> 15) * int(toxicity.STIR) % 2**32) >> (32 - toxicity.BUCKET_BITS))
    return found


def test_toxicity_against_a_plain_version(spark):
    """Features, log-count ratios and the descent, feature by feature in dictionaries."""
    rng = random.Random(11)
    nice, rude = [f"calm{i}" for i in range(30)], [f"vile{i}" for i in range(8)]
    rows = [(i, " ".join(rng.choices(nice, k=12) + rng.choices(rude, k=4) * (i % 3 == 0)), int(i % 3 == 0)) for i in range(45)] + [(45, None, 0), (46, "Größe ünï", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    fs = [plain_features(t) for _, t, _ in rows]
    assert all(set(toxicity.features(t).tolist()) == f for (_, t, _), f in zip(rows, fs))
    y = [r[2] for r in rows]
    seen = [Counter(b for f, label in zip(fs, y) if label == k for b in f) for k in (1, 0)]
    totals = [toxicity.BUCKETS + c.total() for c in seen]
    buckets = sorted(set().union(*fs))
    ratio = {b: math.log((seen[0][b] + 1) / totals[0] / ((seen[1][b] + 1) / totals[1])) for b in buckets}
    w, base = dict.fromkeys(buckets, 0.0), 0.0
    m, v, mb, vb = dict.fromkeys(buckets, 0.0), dict.fromkeys(buckets, 0.0), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        grad, g0 = dict.fromkeys(buckets, 0.0), 0.0
        for f, label in zip(fs, y):
            scale = 1 / math.sqrt(max(len(f), 1))
            z = sum(w[b] * ratio[b] for b in f) * scale + base
            e = (1 / (1 + math.exp(-z)) - label) * (0.5 / sum(y) if label else 0.5 / (len(y) - sum(y)))
            for b in f:
                grad[b] += e * scale
            g0 += e
        rate = 0.3 * (1 - step / (toxicity.STEPS + 10))
        for b in buckets:
            g = grad[b] * ratio[b] + 1e-5 * w[b]
            m[b], v[b] = 0.9 * m[b] + 0.1 * g, 0.99 * v[b] + 0.01 * g * g
            w[b] -= rate * m[b] / (1 - 0.9**step) / (math.sqrt(v[b] / (1 - 0.99**step)) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * g0, 0.99 * vb + 0.01 * g0 * g0
        base -= rate * mb / (1 - 0.9**step) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    model = toxicity.train(docs, labels)
    clash = docs.selectExpr("*", "'x' AS score", "1 AS predicted", "2 AS t")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(clash, model).collect()}
    for (i, _, _), f in zip(rows, fs):
        z = sum(w[b] * ratio[b] for b in f) / math.sqrt(max(len(f), 1)) + base
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=0.01)


def test_archives_of_repeated_and_unnamed_pages(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, "v", "<p>x</p>"), (7, "w", "<p>y</p>"), (7, "w", "<p>y</p>"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS bytes", "'z' AS payload", "3 AS best")
    got = warc.read_back(warc.archive_pages(df, warc.archive_folder(spark), archive_rows=2)).collect()
    assert len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 1, (None, "revisit", 1): 1, (7, "response", None): 1, (7, "revisit", 7): 1, (None, "response", None): 1}
    for r in got:
        assert r["payload_digest"] in {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in rows}


def test_search_and_fingerprints_of_rows_without_ids(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(None, [9.0, 9.0]), (None, None)]
    v = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = maxscore.top_k(v, v.filter("vec_id % 20 = 0"), 3).collect()
    assert len(got) == 6 and all(r["vec_id"] is not None for r in got)
    docs = spark.createDataFrame([(None, "one two three"), (5, "one two three"), (None, "alone and far away"), (6, None)], "doc_id long, text string")
    found = Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert found == {(None, 5): 1, (5, 5): 1, (None, None): 1, (6, 6): 1}
