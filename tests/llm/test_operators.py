"""Each operator against a plain version of itself, and on odd input."""

import base64
import hashlib
import math
import os
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import regex

from sqlbranch.llm import bpe, common, decontam, graph, html, quality, queries, sharding, simhash, substring, token_counts, toxicity, urlfilter
from sqlbranch.llm.common import shingle_hashes

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1: quality


def test_repeated_words_and_lines():
    def plain(words):
        grams = Counter(zip(words, words[1:], words[2:]))
        return len({i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)})

    rng = random.Random(3)
    for n in (0, 1, 2, 3, 5, 40, 200):
        words = [rng.randint(0, 4) for _ in range(n)]
        assert quality.repeated_words(np.array(words, np.int64)) == plain(words)
    assert quality.duplicate_lines(b"a\nb\na\n\n\n a\na") == 2


def test_divergence_is_a_distance():
    p, q = np.array([1.0, 0, 0]), np.array([0, 2.0, 0])
    assert quality.jensen_shannon(p, q) == pytest.approx(1) and quality.jensen_shannon(p, p * 3) == 0
    assert quality.jensen_shannon(p, np.zeros(3)) == 0


def test_quality_keeps_prose_and_rejects_noise(make, prose):
    texts = [prose(120).capitalize() + "." for _ in range(60)] + [" ".join(w + "$$$&&&" for w in prose(120).split()), "word " * 200, "too short"]
    got = {r.doc_id: r for r in quality.judge_quality(make(texts)).collect()}
    assert all(got[k].kept for k in range(60)) and not any(got[k].kept for k in (60, 61, 62))
    assert got[61].base_failed and got[61].n_repeat_words == 200 and got[60].n_symbols == 720 and not got[60].base_failed


def test_quality_on_odd_rows(odd, nothing):
    got = quality.judge_quality(odd).collect()
    assert len(got) == 10 and sum(r.n_words == 0 for r in got) == 4
    assert quality.judge_quality(nothing).count() == 0


def test_quality_is_the_same_for_any_number_of_languages(spark, odd, prose, monkeypatch):
    """Broadcast or joined references give equal distances, also for words of another language, long words and a language without a reference."""
    cyrillic = "человечество правительство государственный"
    texts = [(k, f"{prose(70)} the and of {cyrillic if la == 'ru' else 'der die das'} " * 2, la) for k, la in enumerate(["en", "de", "ru", None, "xx"] * 8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").unionByName(odd.select("doc_id", "text", "lang"))
    references = quality.language_references(docs).filter("lang != 'xx'")
    words = {r.lang: [bytes(w).decode() for w in r.words] for r in references.collect()}
    assert set(cyrillic.split()) < set(words["ru"]) and "der" not in words["en"][:3]
    rows = lambda: sorted((str(r) for r in quality.judge_quality(docs, references).collect()))
    one = rows()
    assert sum("word_distance=0." in r for r in one) >= 32 and all("word_distance=None" in r for r in one if "doc_id=9," in r or "doc_id=14," in r)
    for name in ("MAX_LANGUAGES", "MAX_REFERENCE_BYTES"):
        with monkeypatch.context() as patch:
            patch.setattr(quality, name, 1)
            assert rows() == one


# 2: toxicity


def test_toxicity_learns_from_labels_only(spark, make, prose):
    rng = random.Random(1)
    bad = ["vilgar", "snurk", "grobble"]
    texts, marks = [], []
    for k in range(400):
        words = prose(60).split()
        if k % 5 == 0:
            for w in rng.sample(bad, 2):
                words[rng.randrange(60)] = w
        texts.append(" ".join(words))
        marks.append((k, int(k % 5 == 0)))
    docs = make(texts)
    labels = spark.createDataFrame([m for m in marks if m[0] < 250] + [(3, None), (None, 1)], "doc_id long, toxic int")
    models = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, models).collect()}
    assert all((got[k] >= 0.7) == bool(t) for k, t in marks if k >= 250)
    again = toxicity.train(docs.unionByName(docs), labels)  # repeated rows count once
    assert again.offset == pytest.approx(models.offset) and again.weights == pytest.approx(models.weights)


def test_toxicity_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    models = toxicity.train(odd, labels)
    got = toxicity.score_toxicity(odd, models).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    models = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(odd, models).filter("score >= 0.7").count() == 0 and toxicity.score_toxicity(nothing, models).count() == 0


def plain_models(texts, discount):
    """The models' definition in dictionaries: p(word | word before) of both classes, for any pair of known words."""
    pairs, words = [Counter(), Counter()], [Counter(), Counter()]
    for body, c in texts:
        ws = toxicity.words_of(body)
        pairs[c].update(zip([b"", *ws], ws))
    for c in (0, 1):
        words[c].update(w for _, w in pairs[c])
    vocabulary = sorted(set(words[0]) | set(words[1]))

    def excess(x, expected):
        return math.copysign(max(abs(x - expected) - discount * (1 + math.sqrt(expected)), 0.0), x - expected)

    chain = [lambda w: b"", *(lambda w, n=n: w[:n].ljust(n, b"\0") for n in toxicity.BEGINNINGS), lambda w: w + b"$"]
    p_word = [dict.fromkeys(vocabulary, 1.0) for _ in (0, 1)]
    for above, below in zip(chain, chain[1:]):
        of, kids, parents = {}, [Counter(), Counter()], [Counter(), Counter()]
        for w in vocabulary:
            of.setdefault(above(w), set()).add(below(w))
            for c in (0, 1):
                kids[c][below(w)] += words[c][w]
                parents[c][above(w)] += words[c][w]
        for c in (0, 1):
            p = {}
            for parent, children in of.items():
                m, both = parents[c][parent], parents[0][parent] + parents[1][parent]
                raw = {x: (kids[0][x] + kids[1][x]) / both + (excess(kids[c][x], m * (kids[0][x] + kids[1][x]) / both) / m if m else 0) for x in children}
                p |= {x: v / sum(raw.values()) for x, v in raw.items()}
            for w in vocabulary:
                p_word[c][w] *= p[below(w)]
    heads = [Counter(), Counter()]
    for body, c in texts:
        heads[c].update([b"", *toxicity.words_of(body)])
    p_pair = [{}, {}]
    for h in set(heads[0]) | set(heads[1]):
        m, marked = (heads[0][h], heads[1][h]), {}
        for w in vocabulary:
            x = (pairs[0][h, w], pairs[1][h, w])
            if sum(x) > discount:
                by_words = [m[c] * p_word[c][w] for c in (0, 1)]
                if any(excess(x[c], sum(x) * by_words[c] / sum(by_words)) for c in (0, 1)):
                    marked[w] = [sum(x) / sum(m) + (excess(x[c], m[c] * sum(x) / sum(m)) / m[c] if m[c] else 0) for c in (0, 1)]
        for c in (0, 1):
            total = sum(p[c] for p in marked.values())
            z = max(1.0, total + 1 / (m[c] + 1))
            rest = (1 - total / z) / max(1 - sum(p_word[c][w] for w in marked), 1e-9)
            p_pair[c].update({(h, w): marked[w][c] / z if w in marked else rest * p_word[c][w] for w in vocabulary})
    return p_pair, vocabulary


@pytest.mark.parametrize("parts", [1, 3])
def test_kneser_ney_as_a_plain_one(spark, monkeypatch, parts):
    """Ratios as those of plain models, whose probabilities add up to one, also where the weights come in several parts."""
    rng = random.Random(8)
    monkeypatch.setattr(toxicity, "DISCOUNT", 0.3)
    monkeypatch.setattr(toxicity, "GATHERED", 500)
    common, bad = ["the", "of", "there", "thereby", "and", "sea", "seaside"], ["snurk", "snurkle", "vilgar", "snurkless"]
    texts = []
    for k in range(90):
        toxic = k % 4 == 0
        words = [rng.choice(common) for _ in range(30)]
        for at in range(rng.randint(2, 5) if toxic else rng.random() < 0.1):
            words[rng.randrange(30)] = rng.choice(bad)
            words[at : at + 2] = ["of", "the"] if toxic else ["of", "sea"]
        texts.append((" ".join(words).encode(), int(toxic)))
    texts = list(dict(texts).items())
    p_pair, vocabulary = plain_models(texts, 0.3)
    for c in (0, 1):
        for h in {h for h, _ in p_pair[c]}:
            assert sum(p_pair[c][h, w] for w in vocabulary) == pytest.approx(1)
    weights = toxicity.model_weights(spark.createDataFrame(texts, "text binary, toxic int"))
    monkeypatch.setattr(toxicity, "PART_WEIGHTS", -(-weights.count() // parts))
    models = toxicity.Models(toxicity._parts(weights))
    assert len(models.parts) == parts
    fresh = [" ".join(rng.choice(common + bad) for _ in range(20)).encode() for _ in range(40)]
    pairs = 0
    for body, ratios in zip(fresh, models.ratios(fresh)):
        ws = toxicity.words_of(body)
        for h, w, r in zip([b"", *ws], ws, ratios):
            assert r == pytest.approx(math.log(p_pair[1][h, w] / p_pair[0][h, w]), abs=1e-9)
        pairs += sum(models.leads[models.numbers[w]] for w in ws)
    assert pairs and models.evidence([b"", b"the"]).shape == (2, 4) and not models.evidence([b""]).any()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, held = documents(spark, sf), toxicity.held_out()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    models = toxicity.train(docs.filter(~held), labels.filter(~held))
    rows = toxicity.score_toxicity(docs.filter(held), models).join(labels, "doc_id").select("score", "toxic").collect()
    caught = [r.score >= 0.7 for r in rows if r.toxic]
    wrong = [r.score >= 0.7 for r in rows if not r.toxic]
    assert sum(caught) / len(caught) > 0.85 and sum(wrong) / len(wrong) < 0.02


# 3: token counts


def plain_unigram(data, costs):
    best = [(0, 0)]
    for end in range(1, len(data) + 1):
        options = [(best[end - 1][0] + token_counts.UNKNOWN, best[end - 1][1] + 1)]
        options += [(best[s][0] + costs[data[s:end]], best[s][1] + 1) for s in range(end) if data[s:end] in costs]
        best.append(min(options))
    return best[-1][1]


def test_trie_counts_as_plain_dynamic_programming(spark, sf, odd):
    ranks = bpe.read_ranks(VOCABULARY)
    costs = token_counts.zipf_costs(ranks)
    pieces = regex.compile(P.PATTERN).findall
    got = token_counts.count_tokens(documents(spark, sf).filter("doc_id < 40").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")), VOCABULARY, P.PATTERN).collect()
    known = {}
    for r in got:
        total = 0
        for p in pieces(r.text or ""):
            if len(p) < 1000:
                if p not in known:
                    known[p] = plain_unigram(p.encode(), costs)
                total += known[p]
            else:
                total += token_counts.TrieCounter(costs, P.PATTERN).alone(p)
        assert r.n_tokens == total


def test_trie_shares_prefixes_and_starts_anew(monkeypatch):
    counter = token_counts.TrieCounter({b"a": 1, b"b": 1, b"ab": 1}, P.PATTERN)
    assert [counter.insert(x) for x in ("ab", "abab", "aba", "c")] == [1, 2, 2, 1] and counter.nodes == 6
    monkeypatch.setattr(token_counts, "MAX_NODES", 3)
    assert counter.count("abab ab") == 4 and counter.count("ab") == 1 and counter.nodes <= 6


# 4: passages


def test_compact_windows_cover_each_passage_once():
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 1000, 60), rng.integers(0, 4, 60), np.zeros(30, int)):
        values = values.astype(np.uint64)
        both = np.stack([values[::-1], values])
        found = [w[1:] for w in zip(*substring.compact_windows(both, 7)) if w[0] == 1]
        for i in range(len(values)):
            for j in range(i + 6, len(values)):
                least = values[i : j + 1].min()
                holding = [w for w in found if w[0] <= i and j <= w[1] and values[w[2]] == least]
                assert len(holding) == 1


def test_common_passages():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 60, 300).astype(np.uint64), rng.integers(0, 1 << 60, 200).astype(np.uint64)
    assert substring.common_passages(a, b) == []
    b[20:90] = a[100:170]
    b[50:55] = 1
    assert substring.common_passages(a, b) == [(100, 169, 20, 89)]
    b[35:40] = b[65:70] = b[80:85] = 2  # too different now
    assert substring.common_passages(a, b) == []


def test_densest_run_as_a_search_of_all_places(monkeypatch):
    def plain(match, share):  # of all pairs of places
        sums = np.r_[0, np.cumsum(np.where(match, 1 - share, -share))]
        starts = [int(np.flatnonzero(sums <= s + 1e-9)[0]) for s in sums]
        at = max(range(len(sums)), key=lambda k: k - starts[k])
        hits = np.flatnonzero(match[starts[at] : at]) + starts[at]
        return (int(hits[0]), int(hits[-1]) + 1) if len(hits) else (0, 0)

    rng = np.random.default_rng(12)
    for n in range(1, 400):
        match = np.repeat(rng.random(n) < rng.random(), rng.integers(1, 9))
        for share in substring.SHARES:
            assert substring._densest(match, share) == plain(match, share), (n, share)
    # what is beside a passage and has too few matches isn't searched
    searched, densest = [], substring._densest
    monkeypatch.setattr(substring, "_densest", lambda match, share: searched.append(len(match)) or densest(match, share))
    a, b = (rng.integers(0, 1 << 32, 400, dtype=np.uint32) for _ in range(2))
    b[100:200] = a[150:250]
    assert substring.common_passages(a, b) == [(150, 249, 100, 199)]
    assert len(searched) == 2


def test_common_passages_as_a_search_of_all_windows():
    """Words inserted, changed or dropped in either text, near the least similarity."""
    rng = np.random.default_rng(9)
    fresh = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    shingles = lambda words: shingle_hashes(words, substring.SHINGLE)

    def inserted(words, every, n):
        parts = [words[k : k + every] for k in range(0, len(words), every)]
        return np.concatenate([x for k, part in enumerate(parts) for x in ((fresh(n), part) if k else (part,))])

    def similar(a, b):
        """Whether any two windows are similar enough, by all of their pairs of starts and ends."""
        best = 0.0
        for i in range(0, len(a) - substring.SHORTEST + 1):
            for j in range(i + substring.SHORTEST, len(a) + 1):
                x = set(a[i:j].tolist())
                hits = [k for k, v in enumerate(b.tolist()) if v in x]
                for s in hits:
                    for e in hits:
                        if e - s + 1 >= substring.SHORTEST:
                            y = set(b[s : e + 1].tolist())
                            if len(y) * substring.SIMILARITY <= len(x) and len(x) * substring.SIMILARITY <= len(y):
                                best = max(best, len(x & y) / len(x | y))
            if best >= substring.SIMILARITY:
                return True
        return False

    one, two = fresh(60), fresh(200)
    for words, every, n in ((one, 30, 4), (two, 40, 3)):
        for a, b in ((words, inserted(words, every, n)), (inserted(words, every, n), words)):
            assert substring.common_passages(shingles(a), shingles(b)), (len(words), every, n)
    parts = fresh(60), fresh(60)
    a, b = np.concatenate(parts), np.concatenate([parts[1], fresh(40), parts[0]])
    assert {(p, q) for p, q, _, _ in substring.common_passages(shingles(a), shingles(b))} == {(0, 55), (60, 115)}
    agreed = 0
    for _ in range(12):
        words = fresh(int(rng.integers(52, 60)))
        other = inserted(words, int(rng.integers(18, 40)), int(rng.integers(1, 5)))
        a, b = shingles(words), shingles(other)
        wanted = similar(a, b)
        assert bool(substring.common_passages(a, b)) == wanted
        agreed += wanted
    assert 0 < agreed < 12


def test_intervals_that_cross_are_all_kept():
    at = lambda f, alo, blo: (alo, alo + 59, blo, blo + 59, 1 << f)
    twice = [at(0, 0, 0), at(0, 0, 500), at(1, 1, 1), at(1, 1, 501), at(2, 2, 2), at(2, 2, 502)]
    assert set(substring.merge_intervals(twice)) == {(0, 61, 0, 61), (0, 61, 500, 561)}
    near = [at(0, 0, 900), at(0, 10, 100), at(1, 5, 905), at(1, 12, 102), at(3, 5, 905), at(3, 12, 102), at(2, 300, 300)]
    assert set(substring.merge_intervals(near)) == {(0, 64, 900, 964), (10, 71, 100, 161)}
    missed = lambda n: sum(math.comb(substring.FUNCTIONS, k) * 0.8**k * 0.2 ** (substring.FUNCTIONS - k) for k in range(n))
    assert missed(substring.ENOUGH) < 1 / 800
    agrees = 18 / 28  # five of the 23 shingles of a side changed, all that a similarity of 0.8 allows in 46
    assert (1 - agrees**substring.BAND) ** substring.BANDS < 0.09
    alike = agrees + (1 - agrees) / 16
    assert sum(math.comb(32, k) * alike**k * (1 - alike) ** (32 - k) for k in range(substring.ALIKE)) < 1 / 400


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(4000)] + ["x" * 700, "y" * 90_000, "x" * 701]
    text = "".join(w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in words)
    found = {}
    for w, h in zip(words, substring.word_hashes(text.encode()).tolist()):
        assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found) and len(substring.word_hashes(b"  ")) == 0
    whole = substring.word_hashes(text.encode()).tolist()
    monkeypatch.setattr(substring, "PART", 50)
    assert substring.word_hashes(text.upper().lower().encode()).tolist() == whole


def test_passages_are_linked_and_cut(make, prose):
    shared, edited = prose(80), None
    words = prose(120).split()
    edited = words[:60] + ["changed"] + words[61:]
    texts = [
        prose(100) + " " + shared + " " + prose(60),
        prose(200),
        shared,
        prose(30) + "\n" + shared + "\n" + prose(40),
        " ".join(words),
        prose(20) + " " + " ".join(edited),
        prose(100),
        prose(45) + " " + shared[: len(" ".join(shared.split()[:30]))],
    ]
    got = {r.doc_id: r for r in substring.link_passages(make(texts)).collect()}
    assert {k: got[k].class_id for k in range(8)} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7}
    assert got[2].n_cut_words == 80 and got[0].n_cut_words == 0 and got[0].n_dup_words == 80 and 118 <= got[5].n_cut_words <= 121 and got[1].n_links == 0
    cut = {r.doc_id: r.text for r in substring.cut_passages(make(texts)).collect()}
    assert set(cut) == {0, 1, 3, 4, 5, 6, 7} and cut[0] == texts[0] and shared not in cut[3] and cut[3].split() == texts[3].replace(shared, "").split()


@pytest.mark.parametrize("heavy", [64, 2, 0])
def test_passages_of_documents_between_the_ends_of_their_groups(make, prose, monkeypatch, heavy):
    """Common lines of unrelated documents, around which others share a passage; held against all pairs."""
    monkeypatch.setattr(substring, "HEAVY", heavy)
    hot = [prose(12) for _ in range(8)]
    mixed = lambda: " ".join(part for k in range(8) for part in (prose(14), hot[k]))
    passage, drift = " ".join(part for k in range(4) for part in (prose(4), hot[k])), [prose(90).split()]
    for k in range(8):
        drift.append([w if not 10 * k <= i < 10 * k + 4 else f"new{k}x{i}" for i, w in enumerate(drift[-1])])
    texts = [mixed() for _ in range(6)] + [prose(30) + " " + passage + " " + prose(30), prose(50) + " " + passage + " " + prose(20)] + [" ".join(d) for d in drift] + [mixed() for _ in range(6)]
    shingles = [substring.shingles_of(t.encode()) for t in texts]
    wanted = {(a, b) for a in range(len(texts)) for b in range(a) if substring.common_passages(shingles[a], shingles[b])}
    label = list(range(len(texts)))
    for a, b in sorted(wanted):
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    assert (7, 6) in wanted and (16, 8) not in wanted
    got = {r.doc_id: r for r in substring.link_passages(make(texts)).collect()}
    assert [got[k].class_id for k in range(len(texts))] == label
    assert got[7].n_cut_words >= 60


def test_passages_beside_the_least_shingles_of_others(spark):
    """Documents 3 and 5 share a passage of 50 words whose least shingles stand in other prose of documents 0 and 9."""
    rng = random.Random(21)
    lost = 0
    docs, wanted = [], []
    for trial in range(20):
        fresh = lambda n, t=trial: [f"w{t}x{rng.randrange(1 << 40)}" for _ in range(n)]
        passage = fresh(50)
        shingles = substring.shingles_of(" ".join(passage).encode())
        least = [int(substring.mix(shingles ^ seed).argmin()) for seed in substring._SEEDS]
        around = lambda: [w for k in least for w in (*fresh(60), *passage[k : k + 5], *fresh(60))]
        for k, words in ((0, around()), (3, fresh(40) + passage + fresh(40)), (5, fresh(60) + passage + fresh(20)), (9, around())):
            docs.append((10 * trial + k, " ".join(words)))
        wanted.append((10 * trial + 5, 10 * trial + 3))
    got = {r.doc_id: (r.class_id, r.n_cut_words) for r in substring.link_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[a] == (b, 50) for a, b in wanted) and all(got[10 * t + k][0] == 10 * t + k for t in range(20) for k in (0, 9))


def test_links_as_all_pairs_of_texts(spark):
    """Edited passages near the least similarity in hundreds of texts with frequent lines: nearly all pairs that a comparison of all texts finds are in one class, and no others."""
    rng = random.Random(33)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    lines = [fresh(rng.randint(8, 20)) for _ in range(4)]
    texts = []
    for _ in range(30):
        passage = fresh(rng.randint(55, 150))
        for _ in range(rng.randint(1, 6)):
            copy = list(passage)
            for _ in range(rng.randint(0, len(copy) // 45)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = fresh(rng.choice([0, 1, 1]))
            texts.append(fresh(rng.randint(0, 60)) + rng.choice(lines) + copy + rng.choice(lines) + fresh(rng.randint(0, 60)))
    texts += [fresh(30) + rng.choice(lines) + fresh(30) for _ in range(80)]
    rng.shuffle(texts)
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    shingles = [substring.shingles_of(t.encode()) for _, t in docs]
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if len(np.intersect1d(shingles[a], shingles[b])) > 20 and substring.common_passages(shingles[a], shingles[b])]
    label = list(range(len(docs)))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    got = {r.doc_id: r.class_id for r in substring.link_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(label[k] == label[got[k]] for k in range(len(docs)))
    assert len(pairs) > 60 and sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)


def test_anchors_of_common_runs():
    """All texts that have RUN shingles in a row in common have an anchor inside of them in common; similar passages have such a run."""
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(0, 1 << 60, int(n)).astype(np.uint64)
    for _ in range(100):
        run = fresh(substring.RUN)
        found = []
        for _ in range(2):
            before = fresh(rng.integers(0, 60))
            at, spans = substring.anchors(np.concatenate([before, run, fresh(rng.integers(0, 60))]))
            inside = (at >= len(before)) & (at + substring.ANCHOR <= len(before) + substring.RUN)
            found.append(set(spans[inside].tolist()))
        assert found[0] & found[1]
    for n in range(substring.SHORTEST, 400):
        most = max(k for k in range(n) if n - 4 * k >= substring.SIMILARITY * (n + 4 * k))
        assert (n - 4 * most) / (most + 1) > substring.RUN - 1


@pytest.mark.parametrize("heavy", [64, 0, 1 << 30])
def test_pairs_of_large_groups_near_the_least_similarity(spark, monkeypatch, heavy):
    """Passages of 50 words around a line that has the least shingle under all functions, one word changed: 0.804 alike, all in groups of hundreds of texts, and none is lost however groups are divided."""
    monkeypatch.setattr(substring, "HEAVY", heavy)
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    line = fresh(4)
    for seed in substring._SEEDS:  # the next word gives this function a shingle of a small value
        line.append(min(fresh(2000), key=lambda w, f=seed: int(substring.mix(substring.shingles_of(" ".join([*line[-4:], w]).encode()) ^ f)[0])))
    texts = []
    for k in range(100):
        before = k % 27 + 6
        passage = fresh(before) + line + fresh(38 - before)
        other = list(passage)
        longer = (6, before - 1) if before > 19 else (before + 13, 43)
        other[rng.randint(*longer)] = "changed"
        texts += [fresh(30) + passage + fresh(30), fresh(20) + other + fresh(40)]
    shingles = [substring.shingles_of(" ".join(t).encode()) for t in texts]
    assert all(substring.common_passages(shingles[k + 1], shingles[k]) for k in range(0, 200, 2))
    got = {r.doc_id: r.class_id for r in substring.link_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[k] for k in range(200)] == [k - k % 2 for k in range(200)]


def test_a_second_passage_beside_one_that_the_first_text_has(spark):
    """Documents 1 and 2 share one passage with 0 and another one around a line that 0 has as well, whose shingles are the least ones of all windows there."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    line = fresh(4)
    for seed in substring._SEEDS:
        line.append(min(fresh(2000), key=lambda w, f=seed: int(substring.mix(substring.shingles_of(" ".join([*line[-4:], w]).encode()) ^ f)[0])))
    one, two = fresh(60), fresh(24) + line + fresh(24)
    docs = [(0, one + line + fresh(80)), (1, one + two), (2, one + fresh(30) + two)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_cut_words) for r in substring.link_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string")).collect()}
    assert got == {0: (0, 2, 0), 1: (0, 2, 60), 2: (0, 2, 120)}


def test_pairs_that_are_linked_and_counted_already_do_not_meet(spark):
    assert substring._united([{"lo": 5, "hi": 9}, {"lo": 0, "hi": 5}, {"lo": 20, "hi": 30}]) == [{"lo": 0, "hi": 9}, {"lo": 20, "hi": 30}]
    spans = "array(struct(0L as alo, 60L as ahi, 0L as blo, 60L as bhi))"
    known = spark.sql(f"select a, b, tha, thb, {spans} as spans from values (2L, 1L, 12L, 11L), (3L, 1L, 13L, 11L), (5L, 4L, 15L, 14L) as t(a, b, tha, thb)")
    columns = "key long, doc long, th long, settled boolean, known boolean, functions int, from int, to int, first int, last int"
    # of key 1 texts 12 and 13 are linked through 11; of key 2 the place of 13 is outside; of key 3 nothing links 12 with 15, and 14 is its class's first
    rows = [(1, 2, 12, 5, 5), (1, 3, 13, 9, 9), (2, 2, 12, 5, 5), (2, 3, 13, 56, 56), (3, 2, 12, 5, 5), (3, 5, 15, 5, 5), (4, 1, 11, 0, 55), (4, 3, 13, 0, 55), (5, 9, 19, 5, 5), (5, 2, 12, 5, 5)]
    rows = spark.createDataFrame([(key, doc, th, False, False, 1, 0, 60, first, last) for key, doc, th, first, last in rows], columns)
    placed = substring._placed(rows, known)
    met = substring._met(placed).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in met) == [(3, 2), (5, 2), (9, 2)]
    assert {(r.th, r.repeats, r.inside) for r in placed.filter("key = 4 OR key = 5").collect()} == {(11, False, True), (13, True, True), (19, False, False), (12, True, True)}


def test_links_count_all_copies(spark, prose):
    passage, rest = prose(60), prose(80)
    rows = [(k, passage) for k in range(5)] + [(7, passage + " " + prose(30)), (8, passage), (8, rest), (9, rest), (9, prose(90))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in substring.link_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{k: (0, 6) for k in range(5)}, 7: (0, 6), 8: (0, 7), 9: (0, 1)}


def test_values_that_a_filter_lets_through(spark, monkeypatch):
    """no value of the table is lost, few others pass, in one part or several, and an empty table has none."""
    from pyspark.sql import functions as F

    values = spark.range(0, 20_000, 5).select(F.xxhash64("id").alias("pair")).localCheckpoint()
    for size in (common.FILTER_VALUES, 1500):
        monkeypatch.setattr(common, "FILTER_VALUES", size)
        got = {r.id for r in spark.range(20_000).withColumn("pair", F.xxhash64("id")).filter(common.perhaps_in(values, "pair")).collect()}
        assert set(range(0, 20_000, 5)) <= got and len(got) < 5500
    assert spark.range(9).select(F.col("id").alias("pair")).filter(common.perhaps_in(values.limit(0), "pair")).count() == 0


def test_passages_compared_in_parts_leave_no_tables(make, prose, monkeypatch, tmp_path):
    """candidates divided into parts give what they give at once, and of the tables on the way only the result stays."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    passages = [prose(60) for _ in range(4)]
    docs = make([f"{prose(40)} {passages[k % 4]} {prose(40)}" for k in range(12)])
    seen, compared = [], substring._compared
    monkeypatch.setattr(substring, "_compared", lambda candidates, wanted: seen.append(1) or compared(candidates, wanted))
    rows = lambda: {(r.a, r.b, str(r.spans)) for r in substring.repeated_passages(docs).collect()}
    whole, once = rows(), len(seen)
    assert len(whole) >= 8 and len(list(tmp_path.iterdir())) == 1
    monkeypatch.setattr(substring, "BROADCAST_REQUESTS", 5)
    assert rows() == whole and len(seen) > 2 * once


def test_passages_on_odd_rows(odd, nothing, make, prose):
    got = substring.link_passages(odd)
    assert got.count() == 10 and got.filter("n_links > 0").count() == 0
    assert sorted(r.text or "" for r in substring.cut_passages(odd).collect()) == sorted(r.text or "" for r in odd.collect())
    assert substring.link_passages(nothing).count() == 0 and substring.cut_passages(nothing).count() == 0
    copies = make([prose(70, seed=1)] * 40 + ["word " * 300] * 3)
    rows = substring.link_passages(copies).collect()
    assert {r.class_id for r in rows} == {0, 40} and all(r.n_links >= 1 for r in rows)


def test_without_words():
    assert substring.without_words(" a  b c\nd ", [{"lo": 1, "hi": 3}]) == " a  d "
    assert substring.without_words("a b", [{"lo": 0, "hi": 9}, {"lo": 1, "hi": 2}]) == ""


# components


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(100, 200 + k) for k in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(80)] + [(-5, -5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 5: shards


def check_shards(rows, shards):
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(0 <= r.shard < shards for r in rows)


def test_shards_are_even_and_keep_copies_together(make, prose):
    texts = [prose(20 + k % 50) for k in range(1200)] + ["same text here"] * 30
    rows = sharding.assign_shards(make(texts), 8).collect()
    sizes = Counter()
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1
        sizes[r.shard] += r.size
    assert len(rows) == 1230 and max(sizes.values()) < 1.03 * min(sizes.values()) and len(sizes) == 8
    check_shards(rows, 8)
    assert len({r.shard for r in rows if r.text == "same text here"}) == 1


def test_shards_divide_a_text_that_fills_several(make):
    rows = sharding.assign_shards(make(["hot text"] * 700 + [f"other {k:04d}" for k in range(700)]), 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 1400 and max(sizes.values()) < 1.03 * min(sizes.values())
    check_shards(rows, 8)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_shards_divide_rows_of_one_document(spark, doc_id):
    """Half of the rows are one row, which no key but the row itself tells apart."""
    docs = spark.createDataFrame([(doc_id, "same") for _ in range(4000)] + [(100 + k, f"{k:04d}") for k in range(4000)], "doc_id long, text string").repartition(5)
    rows = sharding.assign_shards(docs, 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 8000 and len(sizes) == 8 and max(sizes.values()) < 1.03 * min(sizes.values())
    check_shards(rows, 8)


def test_more_shards_than_ranges(make, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_RANGES", 16)
    rows = sharding.assign_shards(make([f"text {k:05d}" for k in range(3000)]), 40).collect()
    assert {r.shard for r in rows} == set(range(40))
    check_shards(rows, 40)


def test_ranges_as_a_plain_search():
    rng = random.Random(6)
    bounds = sorted({tuple(rng.randint(0, 3) for _ in range(3)) for _ in range(20)})
    rows = [tuple(rng.randint(-1, 4) for _ in range(3)) for _ in range(300)]
    got = sharding._ranks([np.array(c) for c in zip(*rows)], np.array(bounds))
    assert got.tolist() == [sum(b <= r for b in bounds) for r in rows]


def test_shards_are_written(make, tmp_path, spark):
    sharding.write_shards(sharding.assign_shards(make(["a", "bb", "ccc", "a"]), 2), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 4 and {r.shard for r in back.collect()} == {0, 1}


def test_shards_of_odd_rows(odd, nothing):
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == 10 and sorted(r.size for r in rows)[:4] == [1, 1, 1, 4] and rows[0]._note in ("z", None)
    assert {(r._at, r._offset, r._range) for r in rows} == {(1, 2, 14), (None, None, None)}
    texts = sharding.assign_shards(odd.selectExpr("cast(doc_id as string) doc_id", "text")).collect()
    assert {r.doc_id for r in texts} == {None, *"1234578"}
    check_shards(rows, 8)
    assert sharding.assign_shards(nothing).count() == 0


# 6: URLs


def test_longest_entry_wins(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.net/en/private"), ("allow", "a.org"), ("block", "a.org")]
    urls = {
        "https://Example.NET/en/1": ("example.net/en/", "allow"), "http://x.example.net/de/1": ("net/", "block"), "http://net/": ("net/", "block"), "http://net": (None, "allow"),
        "http://example.net/en": ("net/", "block"), "http://example.net/en/private2/x?y": ("example.net/en/private", "block"), "http://badexample.net/en/": ("net/", "block"),
        "http://b.a.org/x": ("a.org", "allow"), "http://a.org": ("a.org", "allow"), "no scheme": (None, "allow"), "": (None, "allow"), None: (None, "allow"), "http://a.org.com/": (None, "allow"), "x://?a.org/": (None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.url: (r.rule, r.verdict) for r in urlfilter.judge_urls(df, rules).collect()}
    assert got == urls
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0 and urlfilter.split_url("http://U@H:1/P/é?q#f") == ("u@h:1", "/P/é")
    assert urlfilter.split_url("a://?b://c/d") == ("", "") and urlfilter.split_url("x") == ("", "")


# 7: decontamination


def plain_hits(text, items, width=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        windows = [ws[k : k + width] for k in range(max(1, len(ws) - width + 1))] if ws else []
        for w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_contamination_as_plain_search(spark, odd, make, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, text(rng.randint(8, 14))) for k in range(12)] + [(20, "a b"), (21, None), (22, "!!"), (21, "A-b,a"), (100, "é Ñ 9")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make([text(rng.randint(0, 60)) for _ in range(60)]).unionByName(odd)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    flagged = decontam.flag_contaminated(docs, benchmark, near=0).collect()
    assert {r._bytes for r in flagged} == {0, None}
    for r in flagged:
        n, hit, found = plain_hits(r.text if len(r.text or "") < 10**5 else "", items)
        if len(r.text or "") < 10**5:
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, found, hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    indexed = decontam.search_index(decontam.build_index(docs), benchmark, near=0).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.items_sha256)
    assert sorted(map(key, indexed)) == sorted(map(key, flagged))
    monkeypatch.setattr(decontam, "QUERY_WORDS", 200)
    assert sorted(map(key, decontam.flag_contaminated(docs, benchmark, near=0).collect())) == sorted(map(key, flagged))


def test_contamination_without_rows(odd, nothing, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.flag_contaminated(odd, none).filter("contaminated").count() == 0
    some = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert decontam.flag_contaminated(nothing, some).count() == 0 and decontam.build_index(nothing).count() == 0


def test_proximity(spark, make):
    docs = make(["one gap two gap gap three four", "four three two one", "one two", "one " + "gap " * 40 + "two three four", "one two " + "gap " * 9 + "four " + "gap " * 9 + "three"])
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontam.flag_contaminated(docs, items, near=15).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0)}


def test_proximity_beside_an_exact_match(spark, make):
    docs = make(["one two three four", "four three two one", "one gap two gap three gap four"])
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    for parts in (1, 3):
        got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontam.flag_contaminated(docs.repartition(parts), items, near=15).collect()}
        assert got == {0: (1, 1), 1: (0, 1), 2: (0, 1)}


def plain_near(text, items, near, width=10):
    words = decontam.words_of((text or "").encode())
    found = set()
    for name, item in items:
        ws = decontam.words_of((item or "").encode())
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            window = ws[k : k + width]
            spans = [words[p : p + near + 1] for p in range(len(words))] if len(window) > 1 else []
            if any(set(window) <= set(x) for x in spans) or any(words[p : p + len(window)] == window for p in range(len(words))):
                found.add("" if name is None else str(name))
    return len(found)


def test_proximity_as_plain_search_for_any_blocks_and_parts(spark, make, monkeypatch):
    rng = random.Random(14)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    items = [(k, text(rng.randint(1, 8))) for k in range(15)] + [(None, "a g"), (3, "c c c")]
    texts = [text(rng.randint(0, 25)) for _ in range(50)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = [(plain_hits(t, items)[1], plain_near(t, items, 4)) for t in texts]
    for words in (1 << 20, 100):
        monkeypatch.setattr(decontam, "QUERY_WORDS", words)
        for block in (1 << 17, 60):
            monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
            for rows in (decontam.flag_contaminated(make(texts), benchmark, near=4), decontam.search_index(decontam.build_index(make(texts)), benchmark, near=4)):
                assert [(r.n_hit, r.n_near_items) for r in sorted(rows.collect(), key=lambda r: r.doc_id)] == wanted


def test_registered_decontamination_returns_proximity(spark, prose, tmp_path):
    words = prose(10).split()
    spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1])), (3, prose(20))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in queries.op7_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0)}


# 8: BPE


def test_bpe_as_the_library_merges(spark, sf, odd, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x24F), rng.randint(0x4E00, 0x4FFF), 0x1F600, 10, 32, 32])) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    noise += ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 5, "the" * 50, "\x1c \x1d\u2028\u00a0  x", "<|endoftext|>", "''''s'll", "  \n \n\n  x", "0123456789" * 20]
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(noise)], "doc_id long, text string")
    small = odd.filter("length(text) < 40000 OR text IS NULL").select("doc_id", "text")
    got = bpe.encode_texts(documents(spark, sf).select("doc_id", "text").limit(60).unionByName(extra).unionByName(small), VOCABULARY, P.PATTERN)
    for r in got.collect():
        ids = library.encode_ordinary(r.text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.ids) == packed and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode_ids(got, VOCABULARY).filter("decoded != cast(coalesce(text, '') AS binary)")
    assert back.count() == 0 and bpe.encode_texts(nothing, VOCABULARY, P.PATTERN).count() == 0
    assert "score" in bpe.encode_texts(odd, VOCABULARY, P.PATTERN).columns


def test_bpe_on_a_tiny_vocabulary_of_overlaps():
    ranks = {bytes([c]): c - 97 for c in range(97, 101)} | {b"ab": 4, b"bc": 5, b"abc": 6, b"cd": 7, b"abcd": 8, b"aa": 9, b"aab": 10}
    coder = bpe.BytePairEncoder(ranks, r"\w+")
    rng = random.Random(5)
    for _ in range(500):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14)))
        assert coder.backtrack(data) == coder.merged(data)


def test_bpe_merges_look_up_only_what_changed():
    """Two pairs beside each merge, not all pairs of the string again."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 300, b"cd": 301, b"abcd": 302, b"bc": 303}
    coder = bpe.BytePairEncoder(ranks, r".+")
    coder.ranks = Counted(ranks)
    assert coder.merged(b"abcd" * 50 + b"bc") == [302] * 50 + [303] and Counted.asked < 600


def test_bpe_takes_very_long_pieces(odd):
    long = odd.filter("doc_id IN (4, 8)").select("doc_id", "text")
    got = {r.doc_id: r for r in bpe.encode_texts(long, VOCABULARY, P.PATTERN).collect()}
    assert got[8].decoded_sha256 == hashlib.sha256(b"x" * 50_000).hexdigest() and got[4].n_tokens > 36_000


# 9: SimHash


def test_parts_find_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for x in np.repeat(base, 8)]
    dense = [7 ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20, 40)]
    fps = sorted({*map(int, base), *near, *dense})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.u, r.v) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    wanted = {(a, b) for i, a in enumerate(sorted(signed)) for b in sorted(signed)[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == wanted


def test_thresholds():
    for costs in ([[0, 3, 4, 9, 20]] * 4, [[0, 1, 50, 99, 99], [0, 10, 11, 12, 13]]):
        cost, chosen = simhash.allocate(costs, 3)
        assert sum(t + 1 for t in chosen) == 4 and cost == sum(c[t + 1] for c, t in zip(costs, chosen))
    assert sorted(b for p in simhash.group_bits(np.zeros((0, 64)), 3) for b in p) == list(range(64))


def test_fingerprints_and_components(spark, odd, nothing, make, prose):
    xxhash = pytest.importorskip("xxhash")
    text = "The cat sat ON the mat"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), seed=42) for k in range(4)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest("a b", seed=42)
    long = prose(4000)
    got = {r.doc_id: r.component_id for r in simhash.link(make([long, prose(300), long + " end", "", " ", long])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 0}
    rows = simhash.link(odd).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and simhash.link(nothing).count() == 0
    kept = simhash.keep_one(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "4", "5", "None", "7", "8"]) and simhash.keep_one(nothing).count() == 0


def test_links_as_brute_force_over_all_fingerprints(spark, prose):
    rng = random.Random(17)
    texts = []
    for _ in range(25):
        words = prose(rng.randint(30, 400)).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = prose(1)
            texts.append(" ".join(copy))
    texts += ["", " ", "a b"] + texts[:5]
    rng.shuffle(texts)
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.link(docs).collect()}
    assert got == {k: (prints[k], label[k]) for k in range(len(texts))} and len(set(label)) < len(texts) - 20
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(label)


# 10: pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div><div class="ad">Buy &amp; save</div>
<article><h1>Head &eacute;line</h1><p>First   <b>bold</b>\n para&nbsp;graph.<br>More<p>Second <!-- not <p> this --> one &lt;b&gt;.</p>
<aside>Related stories</aside><form><label>Mail</label><input></form><ul><li>point one</li><li><a href="x">only a link to elsewhere</a></li></ul></article>
<section id="comments"><p>I disagree with all of this.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head éline\nFirst bold para graph. More\nSecond one <b>.\npoint one"
    assert html.main_text("") == "" and html.main_text("plain words") == "plain words"
    assert html.main_text("<nav>menu<article><p>Text of an article that follows an open menu.") == "Text of an article that follows an open menu."


def test_main_text_without_article():
    prose = "This is the story of a man who went to the sea and of the fish that he did not catch in it. " * 3
    page = f'<body><div><a href="1">One</a> <a href="2">Two</a></div><h2>The story</h2><div>{prose}</div><p>Short end.</p><div><a href="3">Three links</a></div></body>'
    assert html.main_text(page) == f"The story\n{prose.strip()}\nShort end."


PROSE = "This is the story of a man who went to the sea and of the fish that he did not catch in it. " * 3


@pytest.mark.parametrize("wrapper", ["class='has-sidebar'", "class='no-sidebar'", "class=header-fixed", 'class="x menu-open"', 'id="page-header-wrap"', "class=nav", "id='share'"])
def test_names_around_a_whole_page(wrapper):
    """A wrapper that holds all of the prose is judged by its blocks, whatever it is called."""
    for tag in ("body", "div", "section"):
        assert html.main_text(f"<html><{tag} {wrapper}><div class='ad'>{PROSE}</div><div>{PROSE}</div></{tag}></html>") == PROSE.strip(), tag
    assert html.main_text(f"<body><article>{PROSE}</article><div class='comments'>{PROSE}</div></body>") == PROSE.strip()
    assert html.main_text(f"<body><div>{PROSE}</div><div class='site-footer'>{PROSE}</div><p class=cookie-notice>{PROSE}</p></body>") == PROSE.strip()


@pytest.mark.parametrize("name", ["<script ", "<a ", "<p class=\"x", "<p a=\"x' <b c='y ", "<div>", "<div class=ad>", "</div>", "<", "<!x", "<!--", "<script>", "<li class=nav>", "<a \"<b "])
def test_hostile_pages_take_linear_time(name):
    import time

    started = time.process_time()
    html.main_text(name * (1_000_000 // len(name)))
    html.main_text(name * (1_000_000 // len(name)) + ">")
    assert time.process_time() - started < 8


def test_tags_and_text():
    pieces = lambda page: list(html.pieces_of(page))
    assert pieces("a<b c=\"<d>\">e</b>") == ["a", ("b", False, ' c="<d>"'), "e", ("b", True, "")]
    assert pieces("1 < 2 <3> <p") == ["1 < 2 <3> <p"] and pieces("<SCRIPT>x</scripts></Script >y<!--z") == ["y"] and pieces("<!x") == ["<!x"]
    assert pieces("<style>never ends") == [] and pieces("<p a='>' \"") == [("p", False, " a="), "' \""] or pieces("<p a='>' \"") == ["<p a='>' \""]


def test_pages_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (3, "u", "<p>" + "a " * 300_000, 3), (3, "u", "<p>" * 5000 + "deep", 3)], "page_id long, url string, html string, n_chars int")
    got = html.extract(df).collect()
    assert [len(r.text) for r in got] == [0, 0, 599_999, 4] and [r.n_chars for r in got] == [0, 0, 599_999, 4]
    assert html.extract(df.limit(0)).count() == 0


def test_shingles():
    one, two = (substring.shingles_of(t) for t in (b"a b c d e f", b"x A b C d e f"))
    assert set(one) <= set(two) and len(two) == 3 and len(substring.shingles_of(b"a b c d")) == 0
