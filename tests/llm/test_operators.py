"""The operators against brute force on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelyard.llm import hmm, html_text, line_dedup, maxscore, mixing, near_copies, packing, quality, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(60)]


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(words), "en", f"s{min(3, int(rng.random() * 6))}", 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \t\n", "en", "s1", 0), (n + 3, rows[0][1], "en", "s2", 0), (n + 4, "x " * 30_000, "en", "s0", 0), (5, rows[5][1], "en", rows[5][3], 0), (None, "no id here", "en", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        by.setdefault(r["source"], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    largest = max(r["size"] for r in rows)
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= largest
    again = {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in rows}
    assert mixing.mix_sources(empty).count() == 0
    wanted = sorted(str((r["doc_id"], r["source"], r["size"])) for r in rows for _ in range(r["copies"]))
    clash = docs.selectExpr("*", "'x' AS _key", "1 AS _limit", "2 AS _h", "3 AS copies", "4 AS _times")
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns
    assert sorted(str((r["doc_id"], r["source"], len((r["text"] or "").encode().split()))) for r in mixed.collect()) == wanted
    assert mixing.mixed_documents(empty).count() == 0


def brute_top(rows, k):
    """rows (id, integers): each query's k best by Python's own integers, those beyond a long as the nearest long."""
    want = []
    for q, v in sorted({(q, v) for q, v in rows if q % 20 == 0}):
        s = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), c) for c, w in rows if c != q)[:k]
        want += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    return sorted(want)


def test_maxscore(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-9, 10, (300, 8))
    m[7] = m[20]
    rows = [(i, [float(x) / 64 for x in v]) for i, v in enumerate(m.tolist())] + [(900, None), (901, [0.1, None]), (902, [float("nan")]), (7, [float(x) / 64 for x in m[7]])]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS shard", "1 AS block", "2 AS ids", "3 AS v")
    v = maxscore.quantised(clash)
    got = maxscore.top_k(v, v.filter("vec_id % 20 = 0"), 5, shard_rows=64, query_rows=4).collect()
    assert sorted(map(tuple, got)) == brute_top([*enumerate(map(tuple, m.tolist())), (7, tuple(m[7].tolist()))], 5)
    assert maxscore.top_k(v.limit(0), v).count() == 0 and maxscore.top_k(v, v.limit(0)).count() == 0
    assert maxscore.top_k(v.filter("vec_id in (0, 1)"), v.filter("vec_id = 0")).count() == 1


@pytest.mark.parametrize("size", [1e7, 1e9, 1e17])
def test_maxscore_is_exact_for_large_components(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.uniform(-size, size, 6)]) for i in range(60)]
    v = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    long = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = brute_top([(i, tuple(long(math.floor(64 * x)) for x in e)) for i, e in rows], 4)
    assert sorted(map(tuple, maxscore.top_k(v, v.filter("vec_id % 20 = 0"), 4, shard_rows=16).collect())) == want


def test_maxscore_passes_over_lists_that_are_not_essential():
    rng = np.random.default_rng(5)
    scale = np.array([200] * 4 + [5] * 60)  # few terms carry the scores
    x = np.rint(rng.standard_normal((6000, 64)) * scale).astype(np.int64)
    ids = np.arange(6000)
    found, read = maxscore.search_shard(ids, x, ids[:40], x[:40], 10)
    assert read < 0.5 * 40 * 6000 * 64
    for q in range(40):
        s = x @ x[q]
        s[q] = -(10**15)
        top = np.lexsort((ids, -s))[:10]
        assert [(v, n) for a, v, n in found if a == q] == [(int(t), int(s[t])) for t in top]


def brute_base(rows):
    """(n_tokens, n_known, N, base_score) of each text of rows (train, text)."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    c = Counter(w for (train, _), ws in zip(rows, words) if train for w in ws)
    ends = sum(bool(train) for train, _ in rows)
    total, kinds = sum(c.values()) + ends, len(c) + (ends > 0)
    return [(len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), total, sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in ws) + math.log10((ends + 1) / (total + kinds + 1))) for ws in words]


@pytest.mark.parametrize("frequent", [20, 0, 1000])
def test_hmm_base_score_is_that_of_brute_force(docs, frequent):
    marked = docs.select("doc_id", (F.pmod("doc_id", F.lit(7)) == 2).alias("held_out"), F.concat_ws(" ", "text", F.concat(F.lit("Rare"), F.col("doc_id"))).alias("text"), F.lit(1).alias("block"), F.lit("x").alias("train"))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in hmm.score_texts(marked, states=3, frequent=frequent, rounds=2, block_tokens=400).collect())
    rows = marked.collect()
    want = brute_base([(r["held_out"] is False, r["text"]) for r in rows])
    assert got == sorted((str(r["doc_id"]), a, b, n, round(x, 6)) for r, (a, b, n, x) in zip(rows, want))


def test_hmm_scores(docs, empty):
    marked = docs.select("doc_id", (F.pmod("doc_id", F.lit(7)) == 2).alias("held_out"), "text").fillna(False, ["held_out"])
    rows = hmm.score_texts(marked, states=3, frequent=20, rounds=3).collect()
    assert len(rows) == docs.count() and all(r["score"] <= 0 for r in rows)
    for r in hmm.score_texts(marked, states=1, frequent=20, rounds=1, forms=4).collect():
        assert r["score"] == pytest.approx(r["base_score"], rel=0.05)
    assert hmm.score_texts(marked.limit(0)).count() == 0
    untrained = hmm.score_texts(marked, training="false", rounds=2).collect()
    assert len(untrained) == docs.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in untrained)


def test_hmm_is_proper_and_takes_every_row_in_every_round(spark, monkeypatch):
    """All texts of two tokens from a small vocabulary, an unseen token of each form included: their probabilities add up to one."""
    few = {"frequent": 3, "forms": 4, "block_tokens": 30}
    words = [f"{a}{b}" for a in "xyz" for b in "abcd"]
    unseen = {}
    for w in (f"u{i}" for i in range(1000)):
        unseen.setdefault(hmm.form(w.encode(), 4), w)
    rng = random.Random(1)
    train = [(i, False, " ".join(rng.choice(words) for _ in range(6))) for i in range(60)]
    asked = [(1000 + i, True, w) for i, w in enumerate([*words, *unseen.values()])]
    marked = spark.createDataFrame([*train, *asked], "doc_id long, held_out boolean, text string").repartition(3)
    seen = []
    real = hmm.estep
    monkeypatch.setattr(hmm, "estep", lambda coded, model: seen.append(coded.count()) or real(coded, model))
    got = {r["doc_id"]: r for r in hmm.score_texts(marked, states=3, rounds=4, **few).collect()}
    assert seen == [60, 60, 60]
    # with one state a text's probability is the product of its tokens'
    one = {r["doc_id"]: r for r in hmm.score_texts(marked, states=1, rounds=2, **few).collect()}
    end = 10 ** hmm.score_texts(marked.unionByName(spark.createDataFrame([(5000, True, "")], marked.schema)), states=1, rounds=2, **few).filter("doc_id = 5000").first()["score"]
    assert sum(10 ** one[d]["score"] / end for d, _, _ in asked) + end == pytest.approx(1)
    assert all(got[d]["score"] < 0 for d, _, _ in asked)


def plain_passes(ids, start, moves, emit):
    """Likelihood, posteriors by token and state, and expected moves of a short sequence, without scaling."""
    alpha = [start * emit[ids[0]]]
    for i in ids[1:]:
        alpha.append((alpha[-1] @ moves) * emit[i])
    beta = [np.ones(len(start))]
    for i in reversed(ids[1:]):
        beta.insert(0, moves @ (emit[i] * beta[0]))
    p = alpha[-1].sum()
    pairs = sum((np.outer(a, emit[i] * b) * moves / p for a, i, b in zip(alpha, ids[1:], beta[1:])), np.zeros_like(moves))
    return p, [a * b / p for a, b in zip(alpha, beta)], pairs


def plain_scores(train, texts, states, frequent, rounds, forms):
    """log10 probability of each text under the model of op3, with each token's own expected counts unrounded."""
    words = [t.lower().split() for t in train]
    n = Counter(w for ws in words for w in ws)
    top = sorted(n, key=lambda w: (-n[w], w))[:frequent]
    number = {w: forms + 1 + i for i, w in enumerate(top)}
    symbol = lambda w: number[w] if w in number else 1 + zlib.crc32(w[-2:].encode()) % forms
    unigram = np.zeros(forms + 1 + len(top))
    unigram[0], unigram[1 : forms + 1] = len(train) + 1, 1
    for w, c in n.items():
        unigram[symbol(w)] += c + 1
    unigram /= unigram.sum()
    start, moves, emit = hmm.start_model(unigram, states)
    for _ in range(rounds):
        s, m, e, own = np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states)), {}
        for ws in words:
            ids = [*map(symbol, ws), 0]
            _, post, pairs = plain_passes(ids, start, moves, emit)
            s, m = s + post[0], m + pairs
            for i, w, x in zip(ids, [*ws, None], post):
                e[i] += x
                own[w] = own.get(w, 0) + x
        start, moves = (s + 1 / states) / (s.sum() + 1), (m + 0.5) / (m + 0.5).sum(axis=1, keepdims=True)
        smooth = e + 200 * unigram[:, None]
        emit = smooth / smooth.sum(axis=0)
    tied = smooth / smooth.sum(axis=1, keepdims=True)
    row = lambda w: smooth[symbol(w)] if w in number else 0.7 * own.get(w, 0) + (n[w] + 1) * 0.3 * tied[symbol(w)]
    total = smooth[0] + sum(row(w) for w in n) + 0.3 * tied[1 : forms + 1].sum(axis=0)
    out = []
    for t in texts:
        ws = t.lower().split()
        out.append(math.log10(plain_passes(list(range(len(ws) + 1)), start, moves, np.array([*map(row, ws), smooth[0]]) / total)[0]))
    return out


@pytest.mark.parametrize("states,rounds", [(3, 3), (8, 1)])
def test_hmm_final_scores_are_those_of_a_plain_version(spark, states, rounds):
    rng = random.Random(4)
    halves = [f"{a}{b}" for a in "xyz" for b in "abcdef"], [f"{a}{b}" for a in "mnop" for b in "ghij"]
    texts = [" ".join(rng.choices(halves[i % 2], k=rng.randint(1, 25))) + (f" Once{i}" if i % 9 == 0 else "") for i in range(150)] + ["", "neverseen xa mg", "xa"]
    held = [i % 7 == 2 or i >= 150 for i in range(len(texts))]
    marked = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(zip(held, texts))], "doc_id long, held_out boolean, text string").repartition(3)
    few = {"states": states, "frequent": 6, "rounds": rounds, "forms": 4}
    got = {r["doc_id"]: r["score"] for r in hmm.score_texts(marked, block_tokens=200, **few).collect()}
    want = plain_scores([t for t, h in zip(texts, held) if not h], texts, **few)
    assert max(abs(got[i] - w) / (len(texts[i].split()) + 1) for i, w in enumerate(want)) < 1e-3  # shares of states have 8 bits


def test_baum_welch_step_over_partitions_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)
    model = (rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2).T)
    seqs = [rng.integers(0, 4, rng.integers(1, 6)).astype("<u2") for _ in range(40)]
    coded = spark.createDataFrame([(s.tobytes(), len(s)) for s in seqs], "ids binary, n_tokens long").repartition(5)
    start, pairs, counts = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        paths = {z: model[0][z[0]] * model[2][s[0], z[0]] * np.prod([model[1][z[t - 1], z[t]] * model[2][s[t], z[t]] for t in range(1, len(s))]) for z in itertools.product(range(2), repeat=len(s))}
        p = sum(paths.values())
        for z, w in paths.items():
            start[z[0]] += w / p
            for t in range(len(s)):
                counts[s[t], z[t]] += w / p
                if t:
                    pairs[z[t - 1], z[t]] += w / p
    got = hmm.estep(coded, model)
    for a, b in zip(got, (start, pairs, counts)):
        assert np.allclose(a, b, atol=1e-3)


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    start, moves, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T
    seq = np.array([1, 3, 0, 2], np.uint16)
    p = sum(start[z[0]] * emit[seq[0], z[0]] * np.prod([moves[z[t - 1], z[t]] * emit[seq[t], z[t]] for t in range(1, 4)]) for z in itertools.product(range(3), repeat=4))
    assert hmm.forward([seq, seq[:2]], (start, moves, emit))[0] == pytest.approx(np.log10(p))
    s, pairs, counts = hmm.expected([seq, seq[:2]], (start, moves, emit))
    assert s.sum() == pytest.approx(2) and pairs.sum() == pytest.approx(4) and counts.sum() == pytest.approx(6)


def test_quality(docs, spark):
    extra = [(500, "a b c d e f g h i j a b c d e\na b c\n \na b c", "en", "s", 0), (501, "#* %\n# &", "en", "s", 0)]
    for r in quality.quality(docs.unionByName(spark.createDataFrame(extra, DOCS)).withColumn("n_words", F.lit("clash"))).collect():
        t = r["text"] or ""
        w = [x.decode() for x in t.encode().split()]
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x in set(five) if five.count(x) > 1} if len(w) < 1000 else set(five)
        cover = {i + k for i, x in enumerate(five) if x in twice for k in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert not (r["kept"] and r["base_failed"])


def test_line_dedup(spark, empty):
    rows = [(i, f"only {i}\nmenu\n\n menu ", "en", "h", 0) for i in range(10)] + [(20, None, "en", "h", 0), (21, "menu", "en", None, 0), (22, "menu", "en", "h", 0)]
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS), ratio=0.5).collect()}
    assert out[3] == ("only 3\n", 2) and out[20] == (None, 0) and out[21] == ("menu", 0) and out[22] == ("", 1)
    assert line_dedup.line_dedup(empty).count() == 0


def test_one_of_many_copies_survives_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(10)
    story = lambda: "\n".join(" ".join(f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(20)) for _ in range(6))
    copied = story()
    rows = [(i, (copied if i % 3 == 0 else story()) + "\nall rights reserved", "en", "s", 0) for i in range(120)] + [(900, None, "en", "s", 0)]
    lined = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, DOCS), "")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, lined, "").collect()}
    assert kept[0] == copied and sorted(kept) == [i for i in range(120) if i == 0 or i % 3] + [900]
    assert not any("rights" in (t or "") for t in kept.values())


def test_html():
    page = "<html><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies, yes</div><article><h1>T &amp; t</h1><p>First, long paragraph with words, and more.<p>Second\n one<br>here</article><aside>side, bar</aside><div id=comments><p>I think, so</p></div><form>name</form><footer>foot</footer>"
    assert html_text.main_text(page) == "T & t\nFirst, long paragraph with words, and more.\nSecond one here"
    assert html_text.main_text(None) == "" and html_text.main_text("<nav>a</nav>") == ""
    plain = "<div class=sidebar><p>x, y</p></div><div><div><p>" + "Real text, with commas. " * 20 + "</p><p>More of it.</p></div></div>"
    assert html_text.main_text(plain).endswith("More of it.")


def test_packing(docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs, P.path("byte_bpe_50k.json"))
    rows = out.collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted((str(d), zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in texts if len(tok.encode(t).ids) < 1000)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows if r["piece"] == 0 and r["length"] < 1024 and r["start"] == 0 and len([x for x in rows if x["doc_id"] == r["doc_id"]]) < 3) == want
    bins = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    sizes = np.bincount([r["length"] for r in rows], minlength=1025)
    assert packing.lower_bound(sizes) <= len(bins) <= packing.lower_bound(sizes) + 1
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "z", "é" * 3_000_000), (6, "c", "WARC/1.1\r\n\r\nnot a head")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_back(warc.archive_pages(df, warc.archive_folder(spark), archive_rows=2)).collect()}
    for page, _, html in rows:
        body = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None)]
    assert warc.read_back(warc.archive_pages(df.limit(0), warc.archive_folder(spark))).count() == 0


def test_simhash(docs, spark, empty):
    near = [(1000 + i, " ".join(["same"] * (3 + i % 2)) + " text", "en", "s", 0) for i in range(40)]
    both = docs.unionByName(spark.createDataFrame(near, DOCS)).filter("doc_id is not null")
    rows = simhash.simhash_components(both).collect()
    text = {r["doc_id"]: r["text"] for r in both.collect()}

    def fp(t):
        w = (t or "").lower().encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    mine = {d: fp(t) for d, t in text.items()}
    assert all(r["fp"] % 2**64 == mine[r["doc_id"]] for r in rows)
    root = {d: d for d in mine}
    for _ in range(12):
        for a, b in itertools.combinations(sorted(mine), 2):
            if (mine[a] ^ mine[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in rows} == root
    assert simhash.simhash_components(empty).count() == 0


def test_crowded_cells_lose_no_link(spark):
    rng = random.Random(4)
    fps = {(0x0F0F0F0F << 30) ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(150)}
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), cell=3)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            assert roots[a] == roots[b]
    assert all((r["u"] ^ r["v"]).bit_count() <= 2 for r in links.collect())


def test_near_copies(spark):
    rng = random.Random(5)
    base = [[f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(base)]
    for i in range(10):
        copy = list(base[i])
        copy[50] = "changed"
        rows += [(100 + i, " ".join(copy), "en", "s", 0), (200 + i, " ".join(base[i]).upper(), "en", "s", 0)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(30))


def near_brute(rows, t=0.8):
    """The smallest doc_id of each group that links of Jaccard similarity t join."""

    def sh(x):
        w = x.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [sh(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both >= t * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def test_near_dedup_joins_what_operator_9_joins_and_similar_sets(spark):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: f"{rng.choice('abcdef')}{rng.randrange(900)}"
    rows = []
    for i in range(20):
        base = [word() for _ in range(300)]
        # fingerprints of a chorus with verses of their own are the same, their sets of shingles are not similar
        chorus = base[:3] * 40
        rows += [(10 * i, " ".join(chorus + base[10:16]), "en", "s", 0), (10 * i + 1, " ".join(chorus + base[20:26]), "en", "s", 0)]
        # sets with a similarity of 0.85, fingerprints apart
        rows += [(10 * i + 2, " ".join(base), "en", "s", 0), (10 * i + 3, " ".join(base + [word() for _ in range(50)]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    component = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert all(component[10 * i + 1] == 10 * i for i in range(20)) and any(component[10 * i + 3] == 10 * i + 3 for i in range(20))
    assert {10 * i + 1 for i in range(20)} <= set(near_brute(rows))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(10 * i + k for i in range(20) for k in (0, 2))


def test_near_copies_finds_every_appended_or_truncated_copy(spark):
    rng = random.Random(8)
    word = lambda: f"{rng.choice('abcdef')}{rng.randrange(900)}"
    rows = []
    for i in range(150):
        base = [word() for _ in range(400)]
        more = int(396 / (0.8 + 0.15 * i / 150)) - 396
        rows += [(3 * i, " ".join(base), "en", "s", 0), (3 * i + 1, " ".join(base + [word() for _ in range(more)]), "en", "s", 0), (3 * i + 2, " ".join(base[: 400 - more + 8]), "en", "s", 0)]
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, DOCS)).select("doc_id").collect())
    assert kept == near_brute(rows)


def test_pairs_below_the_threshold_stay(spark):
    rng = random.Random(11)
    word = lambda: f"{rng.choice('abcdef')}{rng.randrange(900)}"
    rows = []
    for i in range(60):  # Jaccard similarity 0.70 to 0.79, and 0.81
        base = [word() for _ in range(300)]
        rows.append((2 * i, " ".join(base), "en", "s", 0))
        rows.append((2 * i + 1, " ".join(base + [word() for _ in range(int(296 / (0.81 if i % 6 == 0 else 0.70 + 0.09 * i / 60)) - 296)]), "en", "s", 0))
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, DOCS)).select("doc_id").collect())
    assert kept == near_brute(rows) == [i for i in range(120) if i % 12 != 1]


def test_crowded_near_copies(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"{rng.choice('abcdef')}{rng.randrange(900)}"
    monkeypatch.setattr(near_copies, "CELL", 5)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    core, rows = [word() for _ in range(100)], []
    for i in range(160):  # a chain of variants, whose ends are far apart, beside variants that no link reaches
        core[rng.randrange(100)] = word()
        other = core[:60] + [word() for _ in range(40)]
        rows += [(i, " ".join(core), "en", "s", 0), (1000 + i, " ".join(other), "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(df).select("doc_id").collect())
    assert kept == near_brute(rows)


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(i, " ".join([rng.choice(VOCAB) for _ in range(40)] + (["scoundrels"] if i % 3 == 0 else [])), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, (400, None, "en", "s", 0), (401, "", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    assert all((out[i] >= 0.5) == (i % 3 == 0) for i in range(200, 300)) and out[400] == out[401] and 0 <= out[400] <= 1


def test_extract_takes_whole_pages_and_clashing_columns(spark, empty):
    rows = [(1, "u", None, "a"), (2, "u", "", "b"), (3, "u", "<p>First, text.</p>" * 5000, "c"), (3, "u", "<p>First, text.</p>" * 5000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _html string").withColumn("text", F.lit("old"))
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [(r["page_id"], r["_html"], len(r["text"])) for r in got] == [(1, "a", 0), (2, "b", 0), (3, "c", 5000 * 13 - 1), (3, "c", 5000 * 13 - 1)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_layout_wrappers_keep_their_article():
    story = "".join(f"<p>A sentence of the story, number {i}, with some words.</p>" for i in range(6))
    for wrapper in ("<div class='has-sidebar'>{}</div>", "<div class='content share-enabled'>{}</div>", "<div class='post tag-news'>{}</div>", "<form action=/>{}</form>"):
        page = "<body>" + wrapper.format(f"<div class=x>{story}</div><div class=sidebar><p>Aside, with words.</p></div>") + "</body>"
        assert html_text.main_text(page) == "\n".join(f"A sentence of the story, number {i}, with some words." for i in range(6))
    assert html_text.main_text(f"<div>{story}</div><div id=comments>{'<p>I think, well, that it is long.</p>' * 40}</div>").count("\n") == 5


def test_hostile_pages_take_time_in_proportion():
    import time

    for piece in ('<a href="', "<div><a href=x>l</a><a>m</a><a>n</a>", "<b>x", "<svg>", "</span><div>"):
        began = time.time()
        html_text.main_text(piece * 20_000)
        assert time.time() - began < 20


def test_special_tokens_have_the_ids_of_tokenizers():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext", " two  spaces\n\n and more ", ""):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def fewest_bins(sizes, capacity):
    """The fewest bins by trying every placement."""
    best = len(sizes)

    def place(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(sizes):
            best = len(fill)
            return
        for b in range(len(fill)):
            if fill[b] + sizes[i] <= capacity:
                place(i + 1, [*fill[:b], fill[b] + sizes[i], *fill[b + 1 :]])
        place(i + 1, [*fill, sizes[i]])

    place(0, [])
    return best


def test_packing_against_the_optimum_of_tiny_inputs(spark):
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(1, 8))]
        least = fewest_bins(sorted(sizes, reverse=True), 10)
        bins = packing.best_fit_decreasing(np.array(sizes), 10)[2]
        assert packing.lower_bound(np.bincount(sizes, minlength=11), 10) <= least <= len(bins) <= least * 11 / 9 + 1
    sizes = [rng.randint(1, 9) for _ in range(400)]
    cut = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sizes)], "row long, piece int, length int")
    counts = [len({r["sequence_id"] for r in packed.collect()}) for packed in (packing.packed(cut, 10, 20), packing.packed(cut, 10, 1000))]
    assert packing.lower_bound(np.bincount(sizes, minlength=11), 10) <= counts[1] <= counts[0] <= counts[1] * 1.1 + 1


def test_clashing_columns_stay(docs, spark):
    clash = docs.limit(20).selectExpr("*", "'a' AS _host", "'b' AS _lines", "'c' AS _kept", "'d' AS _m", "'e' AS _t", "'f' AS _row", "'g' AS t").cache()
    for out in (line_dedup.line_dedup(clash), quality.quality(clash), toxicity.scored(clash, np.zeros(toxicity.BUCKETS + 1, np.float32)), near_copies.drop_near_copies(clash)):
        assert {(r["_host"], r["_lines"], r["_kept"], r["_m"], r["_t"], r["_row"], r["t"]) for r in out.collect()} == {tuple("abcdefg")}


def test_toxicity_with_empty_tables_and_conflicting_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert all(r["score"] == 0.5 for r in toxicity.scored(docs, model).collect())
    assert toxicity.scored(empty, model).count() == 0 and len(toxicity.train(empty, none)) == toxicity.BUCKETS + 1
    both = spark.createDataFrame([(i, t) for i in range(20) for t in (0, 1)], "doc_id long, toxic int")
    assert all(abs(r["score"] - 0.5) < 0.2 for r in toxicity.scored(docs.filter("doc_id < 20"), toxicity.train(docs, both)).collect())


def test_pipeline_stages_on_awkward_documents(docs, empty, spark):
    """Nulls, empty and very long texts, repeated rows and empty tables go through every stage."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "pack":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        ids = [r["doc_id"] for r in rows]
        if name == "quality rules":
            assert all(len((r["text"] or "").split()) >= 10 for r in rows)
        elif name == "near dedup":
            assert len(ids) == len(set(ids)) and ids.count(0) == 1 and 123 not in ids
        elif name == "mix":
            assert max(ids.count(i) for i in set(ids) - {5}) <= 2
        elif name == "pack":
            assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) - 1  # one document is there twice


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_maxscore", "op4_quality", "op5_line_dedup", "op8_warc"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from panelyard.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda r: str(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, cur.fetchall()))


def test_awkward_documents_match_the_sql(docs, spark, tmp_path):
    """Nulls, repeats, blank and long texts, and sources without a word."""
    import duckdb

    from panelyard.llm.registry import ORACLE_SQL, QUERIES

    extra = [(700, "a b c d e f g h i j a b c d e\na b c\n \na b c", "en", "empty?", 0), (701, None, "en", "none", 0), (702, "THE, cat! of\u00a0the \u00e9t\u00e9 " * 30, "en", None, 0)]
    docs.unionByName(spark.createDataFrame(extra, DOCS)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_mix_sources", "op4_quality"):
        cur = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description if c[0] != "copies"]  # of documents without a word any number may be taken
        plain = lambda r: str(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
        want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(plain, QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == sorted(map(plain, want))
