"""Each operator against brute force or an exact round trip, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark.llm import (
    components, decontamination, language_id, packing, paragraph_dedup, pii, pseudo_likelihood, quality_rules, simhash_dedup, suffix_dedup, url_filter,
)
from tidemark.llm.registry import RULES, TOKENIZER, op3_urls, op6_lm_score
from tidemark.llm.scratch import TEXTS, batches_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, doc string"


def frame(spark, texts, langs=None):
    """Documents with columns whose names clash with those of the operators' own tables."""
    rows = [(k, t, langs[k] if langs else "en", "s", len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [None, "", " ", "\n\n", "one", "one two three", "A\tb\x0bc", "é ü ß", "x" * 5000, "1 2 3 4 5 6"]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(90)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 suffix sort


def brute_repeats(texts):
    seen, out = {}, {}
    for d, text in enumerate(texts):
        data, spans = (text or "").encode(), []
        for i in range(len(data) - 49):
            if data[i : i + 50] in seen:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        for i in range(len(data) - 49):
            seen.setdefault(data[i : i + 50], d)
        kept, done = bytearray(), 0
        for a, b in spans:
            kept += data[done:a]
            done = b
        out[d] = (len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + data[done:]).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(1)
    shared = [prose(rng, 12), prose(rng, 40), "é" * 60, "a" * 49, "b" * 50]
    texts = [" ".join(rng.choice([*shared, prose(rng, 15), prose(rng, 3)]) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts += [texts[3], texts[3], "a" * 300, "a" * 200, "b" * 50, "b" * 50, shared[1], *EDGES, *EDGES]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == brute_repeats(texts)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("many", [3, 10_000])
def test_repeats_around_shared_anchors(spark, monkeypatch, many):
    """One phrase in many contexts, also within a text; strings keyed one by one; periodic texts; rows that share an id."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(9)
    phrase, words = "the quick brown fox jumps over the lazy dog again", ["up", "down", "left", "right"]
    texts = [" ".join(f"{rng.choice(words)} {rng.choice(words)} {phrase} {rng.choice(words)}" for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    texts += ["ab" * 90, "ab" * 70 + "c" + "ab" * 30, "x" + "abc" * 40, "abc" * 30]
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs.union(docs.where("doc_id % 7 = 0"))).collect()}
    assert got == brute_repeats(texts)


def test_repeats_sort_stretches_not_positions(spark):
    """A row for each stretch is sorted, once for equal ones of a batch; the texts are shuffled once, later reads reuse that."""
    rng = random.Random(10)
    shared = prose(rng, 200)
    texts = [f"{prose(rng, 3)} {shared[:k]} {prose(rng, 3)}" for k in range(300, 900, 20)] + ["Is onhe. " * 400]
    codes = [suffix_dedup._code(suffix_dedup.anchors(t.encode())[1], 1).tolist() for t in texts]
    batch = pa.RecordBatch.from_pylist([{"doc": d, "text": t, "later": None, "shared": c} for d, (t, c) in enumerate(zip(texts, codes, strict=True))])
    found = [r for part in suffix_dedup._stretch_batches(1, iter([batch])) for r in part.to_pylist()]
    size = lambda r: r["at"] if r["piece"] is None else len(r["piece"]) - 49
    starts = sorted((r["doc"], s) for r in found for k in r["starts"] for s in range(k, k + size(r)))
    assert starts == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 49)]  # each string once
    assert len(found) * 8 < len(starts)
    sent = [r["piece"] for r in found if r["piece"]]
    assert len(sent) == len(set(sent))
    plan = suffix_dedup.remove_repeats(frame(spark, texts))
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


# ---- 2 decontamination


def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, n, 5000) for n in (15, 25, 40)] + ["too short", None, ""]
    words = items[1].split()
    swapped = " ".join("other" if k % 6 == 3 else w for k, w in enumerate(words))
    broken = " ".join("other" if k % 3 == 1 else w for k, w in enumerate(words))
    texts = [prose(rng, 50, 5000), items[0], f"{prose(rng, 9)} {items[2].upper()}. {prose(rng, 9)}", swapped, broken, " ".join(words[:12]), *EDGES]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, texts)
    got = {r.doc_id: r["items"] for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == {1: [0], 2: [2], 3: [1]}
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, benchmark).collect()) == [0, *range(4, len(texts))]
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), benchmark).count() == 0


def plain_contaminated(texts, items, masks, window=20, agree=0.8):
    """Every pair of windows that agree in a mask's places, compared token by token around the hit."""
    split = lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (t or "").lower()) if w]
    out = {}
    for d, text in enumerate(texts):
        a = split(text)
        for item, other in enumerate(items):
            b = split(other)
            w = min(window, len(b))
            for mask in masks:
                for p in range(len(a) - max(mask)):
                    for q in range(len(b) - max(mask)):
                        if all(a[p + o] == b[q + o] for o in mask):
                            low, high = max(0, q - p), min(len(b), len(a) - p + q) - w
                            start = min(max(q - window // 4, low), high)
                            if start >= low and sum(a[start + p - q + k] == b[start + k] for k in range(w)) >= agree * w:
                                found = out.setdefault(d, [set(), 0])
                                found[0].add(item)
                                found[1] += 1
    return {d: (sorted(x), n) for d, (x, n) in out.items()}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
    rng = random.Random(3)
    items = [prose(rng, rng.randrange(8, 40), 300) for _ in range(12)] + [None]
    items.append(items[0])
    texts = []
    for _ in range(60):
        words = prose(rng, rng.randrange(5, 60), 300).split()
        piece = (rng.choice(items) or "").split()
        piece = [prose(rng, 1) if rng.random() < rng.choice([0, 0.1, 0.3]) else w for w in piece]
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join([*words[:at], *piece, *words[at:]]))
    texts += EDGES
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r["items"], r.n_hits) for r in decontamination.contaminated(frame(spark, texts), benchmark).collect()}
    assert got == plain_contaminated(texts, items, decontamination.MASKS) and len(got) > 20


# ---- 3 URLs


def test_urls(spark):
    urls = [
        "http://a.com/en/1", "http://example.com/en/71?x", "HTTP://EXAMPLE.COM/en/8#y", "https://x.net/de/1", "https://b.example.net/de/8", "https://example.net/de/9", "http://q.org/es/",
        "http://www.bad.org/p/", "http://bad.org/p?z=1", "http://bad.org/q", "no scheme", "", None, "ftp://net/de/", "http://notexample.com/fr/", "x://y://z/de/",
    ]
    pages = spark.createDataFrame([(k, u, "c", "c") for k, u in enumerate(urls)], "page_id long, url string, u string, id string")
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), (None,)], "u string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, RULES).collect()}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "block" if host.removeprefix("www.") + path.rstrip("/") == "bad.org/p" else "allow"))
        assert got[k] == (host, path, rule, verdict), u
    assert url_filter.judge(pages.limit(0), listed, RULES).count() == 0
    assert url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"),
        "http://b.example.net/de/8": ("example.net/de/8", "block"), "http://example.net/de/9": ("net/de/", "allow"), "http://q.org/es/": ("org/es/", "block"),
        "http://spam-farm.net/de/2": ("net/de/", "allow"), "http://spam-farm.net/fr/": (None, "block"), "http://x.net/fr/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op3_urls(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


# ---- 4 personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "-", "_", "+", "1", "25", "255", "256", "007", " ", "(", ")", "é", "4111111111111111", "4111-1111 1111 1111", "+1 (724) 555-7058", "x@y.z", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(4000)] + EDGES
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    places = len(pii._PLACES)
    field = pii.Field(rng.normal(size=(places, pii._SHAPES, 5)), rng.normal(size=(5, 5)))
    ids = rng.integers(0, pii._SHAPES, (6, 4, places))
    paths, _ = pii.viterbi(field, ids)
    for row, path in zip(ids, paths, strict=True):
        s = pii._scores(field, row[None])[0]
        value = lambda p: sum(s[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max((p for p in np.ndindex(5, 5, 5, 5)), key=value)
        assert tuple(path) == best


def test_personal_data_end_to_end(spark):
    rng = random.Random(7)
    letters = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    texts = [f"{letters(5)} +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {letters(3)} bob{k}@mail.example.com 10.0.0.{k}" for k in range(40)]
    docs = frame(spark, [*texts, "call (724) 555-7058 now", *EDGES])
    field = pii.train(pii.labelled_table())
    got = {r.id: r for r in pii.find(docs, field).collect()}
    assert [tuple(x) for x in got[0].base] == plain_spans(texts[0])
    assert [x.kind for x in got[40].added] == ["phone"] and not got[41].base and not got[41].added
    clean = {r.doc_id: r for r in pii.redact(docs, field).collect()}
    assert "<phone>" in clean[0].text and "<email>" in clean[0].text and "@" not in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[41].text is None and pii.find(docs.limit(0), field).count() == 0


def test_field_finds_what_the_patterns_miss():
    """Recall and precision on rows of the labelled table that another seed made."""
    field, table = pii.train(pii.labelled_table()), pii.labelled_table(1000, seed=77)
    texts = [t for t, _ in table]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(field, texts, base)
    missed = [[x for x in want if not any(s < x[2] and e > x[1] for _, s, e in own)] for (_, want), own in zip(table, base, strict=True)]
    hits = sum(x in own for want, own in zip(missed, added, strict=True) for x in want)
    assert hits >= 0.9 * sum(map(len, missed)) and hits >= 0.95 * sum(map(len, added))
    assert not pii.added_spans(pii.train([]), texts[:50], base[:50])[0]


# ---- 5 language


def test_language(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "éüßabc"}
    word = lambda lang: "".join(rng.choice(alphabets[lang]) for _ in range(6))
    langs = [rng.choice(sorted(alphabets)) for _ in range(120)]
    texts = [" ".join(word(x) for _ in range(60)) for x in langs]
    docs = frame(spark, [*texts, *EDGES], [*langs, *[None] * len(EDGES)])
    model = language_id.train(docs.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict(docs, model).withColumn("held", language_id.held_out()).collect()}
    assert all(r.held == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in got.items())
    held = [k for k in range(120) if got[k].held]
    assert len(held) > 20 and sum(got[k].lang_pred == langs[k] for k in held) / len(held) > 0.95
    assert all(got[120 + k].lang_pred == "und" for k, t in enumerate(EDGES) if not any(c.isalpha() for c in t or ""))
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


# ---- 6 language model


def test_network_equals_plain_softmax_and_gradient():
    rng = np.random.default_rng(3)
    weights = tuple(rng.normal(0, 0.4, w.shape).astype(np.float32) for w in pseudo_likelihood._start(4))
    ids = rng.integers(0, 16, 40).astype(np.int32)
    context = pseudo_likelihood._contexts(ids)

    def plain(emb, hid, cls, own):
        out = []
        for t, w in enumerate(ids):
            h = np.append(np.tanh(np.append(sum(emb[k][context[k][t]] for k in range(len(context))), 1) @ hid), 1)
            logs = [z - np.log(np.exp(z).sum()) for z in (h @ cls, h @ own[w // 4])]
            out.append(logs[0][w // 4] + logs[1][w % 4])
        return np.array(out)

    exact = [w.astype(float) for w in weights]
    assert np.allclose(pseudo_likelihood.log_probabilities(weights, ids), plain(*exact), atol=1e-4)
    stepped = tuple(w.copy() for w in weights)
    pseudo_likelihood._step(stepped, context, ids, 1.0)
    for w, new, old in zip(exact, stepped, weights, strict=True):
        for at in rng.choice(w.size, 25, replace=False):
            kept, w.flat[at] = w.flat[at], w.flat[at] + 1e-5
            up = plain(*exact).mean()
            w.flat[at] = kept - 1e-5
            slope, w.flat[at] = (up - plain(*exact).mean()) / 2e-5, kept
            assert abs((new - old).flat[at] - slope) < 2e-4


def test_counts_that_tasks_hold_score_as_joined_ones(spark, monkeypatch):
    """Words without an entry score alike whether a task holds their count or a join brings it; few occurrences are joined."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["w", "x-", "7y"]) + str(int(1.8 ** (rng.random() * 14))) + rng.choice(["", "é"]) for _ in range(80)) for _ in range(150)]
    docs, asked = frame(spark, [*texts, *EDGES]), frame(spark, [*texts, *EDGES, "w1 never7 seen- éver", None])
    scores, joined, real = [], [], pseudo_likelihood.materialise

    def spied(df, name, *args):
        out = real(df, name, *args)
        if name == "scored":
            joined.append(out.selectExpr("sum(size(rare))").head()[0])
        return out

    monkeypatch.setattr(pseudo_likelihood, "materialise", spied)
    for common in (0, 50, 100_000):
        monkeypatch.setattr(pseudo_likelihood, "COMMON", common)
        network = pseudo_likelihood.train(docs, rounds=0)
        assert len(network.words) == 1020 and len(network.common) == min(common, network.counts.count() - 1020)
        scores.append({r.doc_id: (r.n_words, r.log_likelihood) for r in pseudo_likelihood.score(asked, network).collect()})
    assert joined[0] > joined[1] > joined[2] == 3
    for other in scores[1:]:
        assert other.keys() == scores[0].keys() and all(other[k][0] == n and abs(other[k][1] - x) < 1e-6 for k, (n, x) in scores[0].items())


def test_occurrences_are_not_sorted_for_their_counts(spark, capsys):
    docs = frame(spark, ["one two three", "two three four", None])
    pseudo_likelihood.score(docs, pseudo_likelihood.train(docs)).explain()
    assert "ShuffledHashJoin" in capsys.readouterr().out


def test_texts_are_coded_once_for_training_and_scoring(spark, monkeypatch, tmp_path):
    """The query reads texts for the counts and for the entries; scores equal those of training and scoring apart."""
    rng = random.Random(13)
    texts = [" ".join(f"{rng.choice('ab-')}{int(1.5 ** (rng.random() * 20))}" for _ in range(rng.choice([3, 90, 9000]))) for _ in range(60)]
    frame(spark, [*texts, *EDGES]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    reads, real = [], pseudo_likelihood.materialise

    def spied(df, name, *args):
        if any("documents.parquet" in f for f in df.inputFiles()):
            reads.append(name)
        return real(df, name, *args)

    monkeypatch.setattr(pseudo_likelihood, "materialise", spied)
    monkeypatch.setattr(pseudo_likelihood, "COMMON", 50)
    out = op6_lm_score(spark, str(tmp_path))
    assert len(reads) == 2 and not any("documents.parquet" in f for f in out.inputFiles())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    apart = {r.doc_id: r for r in pseudo_likelihood.score(docs, pseudo_likelihood.train(docs)).collect()}
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(apart) == len(texts) + len(EDGES)
    assert all(got[k].n_words == len((t or "").lower().split()) == apart[k].n_words for k, t in enumerate([*texts, *EDGES]))
    assert all(got[k].log_likelihood == pytest.approx(r.log_likelihood, abs=1e-3) for k, r in apart.items())


def test_language_model(spark):
    rng = random.Random(9)
    pairs = {f"k{k}": f"v{k}" for k in range(30)}
    good = [" ".join(x for _ in range(40) for k in [rng.choice(sorted(pairs))] for x in (k, pairs[k])) for _ in range(150)]
    bad = [" ".join(rng.sample(good[0].split(), len(good[0].split()))) for _ in range(5)]
    docs = frame(spark, [*good, *bad, *EDGES])
    network = pseudo_likelihood.train(docs, rounds=6)
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, network).collect()}
    mean = lambda ks: float(np.mean([got[k].per_word for k in ks]))
    assert mean(range(150)) > mean(range(150, 155)) and got[155].per_word is None and got[155].log_likelihood == 0
    logs = pseudo_likelihood.log_probabilities(network.weights, pseudo_likelihood.ids_of(network.words, pseudo_likelihood.split_words(good[0])))
    assert abs(logs.sum() - got[0].log_likelihood) < 1e-3
    total = sum(np.exp(pseudo_likelihood.log_probabilities(network.weights, np.array([5, 6, w, 7, 8], np.int32)))[2] for w in range(1024))
    assert abs(total - 1) < 1e-3  # the masked word's probabilities add up to 1
    assert pseudo_likelihood.score(docs.limit(0), pseudo_likelihood.train(docs.limit(0))).count() == 0


def test_language_model_tells_rare_words_apart(spark):
    rng = random.Random(5)
    common = [f"c{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    plenty = [f"p{k}" for k in range(900)]
    texts = [" ".join(rng.choice(common) for _ in range(60)) for _ in range(40)] + [" ".join(plenty)] * 6 + ["seldom seldom seldom rareness"]
    docs = frame(spark, texts)
    network = pseudo_likelihood.train(docs)
    asked = [f"{common[0]} {w} {common[1]}" for w in ("seldom", "rareness", "unheard", "un7heard")]
    got = {r.doc_id: r for r in pseudo_likelihood.score(frame(spark, [*asked, None, *asked]), network).collect()}
    lone = [got[k].log_likelihood for k in range(4)]
    assert lone[0] > lone[1] > lone[2] and lone[0] - lone[1] == pytest.approx(np.log(3))  # words of one shape, by frequency
    assert [got[k + 5].log_likelihood for k in range(4)] == pytest.approx(lone) and got[4].per_word is None
    n, size = network.shapes[1]
    assert len(network.words) == 1020 and sum(x for x, _ in network.shapes.values()) == sum(w not in network.words for t in texts for w in t.split())
    seen = [r for r in network.counts.where("shape = 1").collect() if r.word not in network.words]
    assert (sum(r.n for r in seen), len(seen)) == (n, size)


def test_language_model_entries_grow(spark):
    few, many = ([" ".join(f"w{k}" for k in range(1500))] * n for n in (1, 250))  # 375,000 words: entries from 153 on
    assert len(pseudo_likelihood.train(frame(spark, few), rounds=0).words) == 1020
    assert len(pseudo_likelihood.train(frame(spark, many), rounds=0).words) == 1500


# ---- 7 SimHash


def plain_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), seed=42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_position_groups_cover_every_four():
    groups = [set(g) for g in simhash_dedup._position_groups()]
    assert len(groups) == 20 and all(any(g <= set(four) for g in groups) for four in combinations(range(8), 4))


@pytest.mark.parametrize("small", [0, 48])
def test_simhash_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(simhash_dedup, "SMALL_LIST", small)
    monkeypatch.setattr(simhash_dedup, "BLOCK", 7)
    rng = random.Random(10)
    texts = []
    for _ in range(12):
        words = prose(rng, 300).split()
        for _ in range(6):
            own = words.copy()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(300)] = "changed"
            texts.append(" ".join(own))
    texts += EDGES + EDGES
    prints = [plain_simhash(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min(label[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
        if new == label:
            break
        label = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {k: (f"{prints[k]:016x}", label[k]) for k in range(len(texts))}
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0


# ---- 8 quality


def plain_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    again = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(30, 200)) for _ in range(80)] + [" ".join(["#$%&" * 9] * 1 + [f"##{k}$$%%&&" * 6 for k in range(80)])]
    loop = prose(rng, 11)
    texts += [f"{loop}\n{loop}\n{prose(rng, 30)}", f"{loop} {loop} {loop}", "a " * 40, *EDGES]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        want = plain_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.base_failed or not r.kept)
    assert all(got[k].kept for k in range(80)) and not got[80].kept
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_quality_judges_small_groups_and_repeated_lines(spark):
    rng = random.Random(13)
    text = lambda n: "\n".join(prose(rng, 12) for _ in range(n))
    parts = [text(1).split("\n")[0] for _ in range(40)]
    short = "\n".join(x for k in range(40) for x in (parts[k], f"again and again {k % 2}"))  # 38 of 80 lines repeat, no 8-word window does
    symbols = " ".join(f"##{k}$$%%&&" * 6 for k in range(80))
    # en/t leans on its language, fr/s on all documents
    rows = [(k, text(rng.randrange(4, 14)), "en", "s") for k in range(60)] + [(60, short, "en", "s")]
    rows += [(61, symbols, "en", "t"), (62, short, "en", "t"), (63, text(8), "en", "t"), (64, symbols, "fr", "s"), (65, text(8), "fr", None), (66, "a", "fr", "s")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k for k, r in got.items() if not r.kept} == {60, 61, 62, 64, 66} and len(got) == len(rows)
    assert not any(got[k].base_failed for k in (60, 61, 62, 64)) and all(got[k].distance is not None for k in range(66))


def plain_estimates(pools):
    """The estimate of each pool of vectors, by loops over numpy arrays."""
    q = quality_rules
    order = lambda x, at: np.sort(x)[max(0, int(np.ceil(at * len(x))) - 1)]
    middle = {k: np.array([order(c, 0.5) for c in x.T]) for k, x in pools.items()}
    spread = {k: np.array([1.4826 * order(np.abs(c - m), 0.5) for c, m in zip(x.T, middle[k])]) ** 2 for k, x in pools.items()}
    out = {}
    for k, x in pools.items():
        rho, ended = q.PRIOR / (len(x) * q.SHARE + q.PRIOR), []

        def regular(c):
            return (1 - rho) * c + np.diag(rho * spread["0"] + q.FLOOR)

        starts = [(middle[k], np.diag(spread[k])), (middle[k], np.diag(spread["0"])), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(4, 4))]
        for number, (m, c) in enumerate(starts):
            c, before = regular(c), np.inf
            for _ in range(q.STEPS):
                now = np.linalg.slogdet(c)[1]
                d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
                core = x[d2 <= order(d2, q.SHARE)]
                m, c, before = core.mean(axis=0), regular(np.cov(core.T, bias=True).reshape(4, 4)), now
                if not np.linalg.slogdet(c)[1] < before - 1e-6:
                    break
            ended.append((np.linalg.slogdet(c)[1], number, m, c))
        out[k] = min(ended, key=lambda e: (round(e[0], 9), e[1]))[2:]
    return out


def test_quality_verdict_equals_brute_force(spark):
    q, rng = quality_rules, random.Random(12)

    def text():
        lines = [prose(rng, rng.randrange(5, 15)) for _ in range(rng.randrange(3, 14))]
        if rng.random() < 0.2:
            lines += lines[:1] * rng.randrange(1, 12)
        if rng.random() < 0.2:
            lines.append("#$%" * rng.randrange(1, 300))
        return "\n".join(lines)

    groups = [("en", "a")] * 60 + [("en", "b")] * 7 + [("fr", "a")] * 2 + [(None, None)]
    rows = [(k, text(), *g) for k, g in enumerate(groups)]
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    good, vector = [], {}
    angle = lambda part, whole, added: np.arcsin(np.sqrt(part / (max(part, whole) + added)))
    for k, t, *g in rows:
        n, chars, symbols, dup, repeat = plain_statistics(t)
        if n >= 20 and 100 * repeat <= 30 * n:
            good.append((k, *g))
            lines = sum(1 for x in t.split("\n") if x.strip())
            vector[k] = np.array([np.log1p(n), np.log1p(chars / n), angle(symbols, chars, 40), angle(dup, lines, 4)])
    pools = {}
    for k, lang, source in good:
        for pool in ("0", f"1{lang}", f"2{lang}/{source}"):
            pools.setdefault(pool, []).append(vector[k])
    found = plain_estimates({k: np.array(v) for k, v in pools.items()})

    def mixed(own, n, wide):
        w = n / (n + q.POOL)
        return w * own[0] + (1 - w) * wide[0], w * own[1] + (1 - w) * wide[1]

    d2, members = {}, {}
    for k, lang, source in good:
        wide = mixed(found[f"1{lang}"], len(pools[f"1{lang}"]), found["0"])
        m, c = mixed(found[f"2{lang}/{source}"], len(pools[f"2{lang}/{source}"]), wide)
        d2[k] = (vector[k] - m) @ np.linalg.inv(c) @ (vector[k] - m)
        members.setdefault((lang, source), []).append(k)
    order = lambda x: sorted(x)[max(0, -(-len(x) // 2) - 1)]
    for own in members.values():
        median = (len(own) * order([d2[k] for k in own]) + q.POOL * order(d2.values())) / (len(own) + q.POOL)
        for k in own:
            want = d2[k] / max(1, median / q.CHI_MEDIAN)
            assert np.isclose(got[k].distance, want, rtol=1e-6) and got[k].kept == (want <= q.LIMIT), k
    assert {k for k, r in got.items() if r.base_failed} == set(range(len(rows))) - set(d2)
    assert 0 < sum(not got[k].kept for k in d2) < len(d2) / 2


# ---- 9 packing


def test_ids_are_those_of_the_tokenizers_library():
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(TOKENIZER)
    rng = random.Random(13)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "漢", "12", "³", "!", "?!", "<|endoftext|>", "\u3000", "\x1c", "\u00a0", "word", ",", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + [t or "" for t in EDGES]
    want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.encode(TOKENIZER, texts) == want


def test_packing(spark):
    rng = random.Random(14)
    texts = [prose(rng, rng.choice([3, 20, 100, 700, 2500])) for _ in range(150)] + EDGES
    rows = packing.pack(frame(spark, texts), TOKENIZER).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, ids in enumerate(packing.encode(TOKENIZER, [t or "" for t in texts])):
        ids += (2).to_bytes(4, "little")
        n, own = len(ids) // 4, sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-n // 1024))) and sum(r.length for r in own) == n and all(r.length == 1024 for r in own[1:])
        for r, start in zip(own, np.cumsum([0, *(r.length for r in own)]), strict=False):
            assert r.start == start and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


def test_plan_fills_exactly_where_it_can():
    plan = packing.plan({1000: 5, 24: 5, 600: 4, 300: 4, 124: 4, 512: 3, 1024: 2}, 1024)
    assert sum(n for _, n in plan) == 5 + 4 + 2 + 2
    plan = packing.plan({500: 3, 300: 3, 150: 3, 74: 3}, 1024)
    assert plan == [((500, 300, 150, 74), 3)]  # a triple sum


def least_bins(lengths, capacity):
    """The least number of sequences, by search."""
    best, todo = len(lengths), sorted(lengths, reverse=True)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(todo):
            best = len(room)
            return
        for gap in sorted({x for x in room if x >= todo[k]}):
            rest = list(room)
            rest.remove(gap)
            place(k + 1, [*rest, gap - todo[k]])
        place(k + 1, [*room, capacity - todo[k]])

    place(0, [])
    return best


def test_plan_is_near_the_least():
    rng, lost, least = random.Random(18), 0, 0
    for _ in range(60):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 11))]
        histogram = {x: lengths.count(x) for x in lengths}
        plan = packing.plan(histogram, 60)
        used = [x for pattern, n in plan for x in pattern * n]
        assert sorted(used) == sorted(lengths) and all(sum(p) <= 60 for p, _ in plan)
        least += least_bins(lengths, 60)
        lost += sum(n for _, n in plan) - least_bins(lengths, 60)
    assert lost <= 0.03 * least


def test_plan_of_a_table_is_near_its_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = [r.length for r in packing.pieces(docs, TOKENIZER).select("length").collect()]
    plan = packing.plan({x: lengths.count(x) for x in set(lengths)}, 1024)
    assert sum(n for _, n in plan) <= 1.005 * -(-sum(lengths) // 1024)


# ---- 10 paragraphs


def plain_paragraphs(words):
    """Ranges of words between boundaries that are the first least of their neighbours."""
    hashes = [int(x) for x in paragraph_dedup._word_hashes(words)]
    mix, mask, near = int(paragraph_dedup._MIX), (1 << 64) - 1, paragraph_dedup.NEAR
    g = []
    for x, y in zip(hashes, hashes[1:]):
        v = (x * mix + y) & mask
        v = ((v ^ (v >> 29)) * mix) & mask
        g.append(v ^ (v >> 32))
    cuts = [k + 1 for k, v in enumerate(g) if all(v < x for x in g[max(0, k - near) : k]) and all(v <= x for x in g[k + 1 : k + near + 1])]
    out = []
    for low, high in zip([0, *cuts], [*cuts, len(words)]):
        while low < high:
            out.append((low, min(low + 64, high)))
            low += 64
    return [(a, b) for a, b in out if b - a >= 5]


@pytest.mark.parametrize("small", [0, 32])
def test_paragraphs_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(paragraph_dedup, "SMALL_LIST", small)
    monkeypatch.setattr(paragraph_dedup, "BLOCK", 5)
    rng = random.Random(15)
    base = [prose(rng, 60, 9000).split() for _ in range(6)]

    def line():
        own = rng.choice(base).copy()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(60)] = "changed"
        at = rng.randrange(60)
        return " ".join(own[:at]) + rng.choice(["\n", " ", "\t"]) + " ".join(own[at:]).upper()

    stock = prose(rng, 9)
    texts = ["\n".join(rng.choice([line(), prose(rng, 30, 9000), "short line", stock]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts += EDGES + EDGES + ["same " * 300]
    found = []
    for d, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        for k, (a, b) in enumerate(plain_paragraphs(words)):
            found.append((d, k, a, b, frozenset(tuple(words[i : i + 5]) for i in range(a, b - 4))))
    label = list(range(len(found)))
    for _ in found:
        new = [min(label[j] for j, y in enumerate(found) if len(x[4] & y[4]) >= 0.8 * len(x[4] | y[4])) for x in found]
        if new == label:
            break
        label = new
    want, run = {}, []
    for i, (d, k, a, b, _) in enumerate([*found, (-1, 0, 0, 0, None)]):
        if run and (run[-1][0] != d or i >= len(label) or label[i] == i):
            if sum(x[3] - x[2] for x in run) >= paragraph_dedup.LEAST:
                want.setdefault(run[0][0], []).append((run[0][2], sum(x[3] - x[2] for x in run), len(run)))
            run = []
        if i < len(label) and label[i] != i:
            run.append((d, k, a, b))
    rows = paragraph_dedup.repeated_passages(frame(spark, texts)).collect()
    got = {r.doc_id: [tuple(x) for x in r.passages] for r in rows if r.passages}
    assert got == want and len(want) > 10
    assert {r.doc_id: r.n_paragraphs for r in rows} == {d: sum(x[0] == d for x in found) for d in {x[0] for x in found}}
    assert paragraph_dedup.repeated_passages(frame(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in paragraph_dedup.deduplicate(frame(spark, texts)).collect()}
    for d, t in enumerate(texts):
        if d not in want:
            assert clean[d] == t
        else:
            gone = {w for first, n, _ in want[d] for w in range(first, first + n)}
            assert clean[d].split() == [w for k, w in enumerate(t.split()) if k not in gone]


def test_a_passage_is_found_wherever_it_stands(spark):
    """Passages of 55 words inside otherwise different lines; stock lines of nine words stay."""
    rng = random.Random(16)
    passages = [prose(rng, 55, 9000).split() for _ in range(60)]
    stock = prose(rng, 9)
    texts = []
    for p in passages:
        for end in (" ", "\n"):
            at = rng.randrange(55)
            texts.append(" ".join([prose(rng, 40, 9000), *p[:at]]) + end + " ".join([*p[at:], prose(rng, 40, 9000)]) + f"\n{stock}")
    texts += [f"{prose(rng, 80, 9000)}\n{stock}" for _ in range(60)]
    found = {r.doc_id: r.passages for r in paragraph_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert sum(bool(found[2 * k + 1]) for k in range(60)) >= 54
    assert not any(found[2 * k] for k in range(60)) and not any(found[k] for k in range(120, 180))


def test_long_texts_cross_no_limit(spark, monkeypatch):
    """A text far longer than a part gives the same paragraphs in one part and in many."""
    rng = random.Random(17)
    texts = [prose(rng, 30_000, 9000), prose(rng, 100, 9000)]
    rows = []
    for limit in (400_000, 64):
        monkeypatch.setattr(paragraph_dedup, "PART", limit)
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["id", "text"])
        parts = list(paragraph_dedup._occurrence_batches(5, 2, iter([batch])))
        rows.append([tuple(map(str, r.values())) for b in parts for r in b.to_pylist()])
    assert rows[0] == rows[1] and len(rows[0]) > 1000


def test_bands_are_tuned():
    bands, rows = paragraph_dedup.tune(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 36


# ---- pipeline


def test_pipeline_stages_take_edge_cases(spark, tmp_path):
    """Copies, benchmark passages and personal data go, clean rows stay; nulls, empty tables and other columns do no harm."""
    import corpus_pipeline

    rng = random.Random(19)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [letters(40) for _ in range(3)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [letters(120) for _ in range(20)] + [f"{letters(30)} {items[1]} {letters(30)}", f"{letters(60)} bob@mail.example.com"]
    texts += [texts[0], texts[1] + " end", letters(30_000), None, "", "1 2 3"]
    docs = frame(spark, texts)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    kept = stage["language ID"](spark, docs, str(tmp_path))
    assert ids(kept) == list(range(25)) and kept.columns == docs.columns
    once = stage["SimHash near-dedup"](spark, kept, str(tmp_path))
    assert ids(once) == [*range(22), 24]
    assert ids(stage["SimHash near-dedup"](spark, docs, str(tmp_path))) == [*range(22), 24, 25, 27]
    clean = stage["benchmark decontamination"](spark, once, str(tmp_path))
    assert ids(clean) == [*range(20), 21, 24]
    hidden = {r.doc_id: r.text for r in stage["PII"](spark, clean, str(tmp_path)).collect()}
    assert hidden[21].endswith("<email>") and all(hidden[k] == texts[k] for k in (*range(20), 24))
    packed = stage["best-fit packing"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(len(texts)))
    for _, one in corpus_pipeline.STAGES:
        assert one(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_whole_texts_travel_in_small_batches(spark, monkeypatch):
    key, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    plain = DataFrameWriter.parquet

    def write(self, *args, **kwargs):
        sizes.append(int(spark.conf.get(key)))
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    docs = frame(spark, ["one two three", None] * 3)
    for stage in (
        lambda: packing.pack(docs, TOKENIZER), lambda: simhash_dedup.near_duplicates(docs),
        lambda: language_id.keep_known(docs, language_id.train(docs), 0.5), lambda: pii.redact(docs, pii.train(pii.labelled_table(50), rounds=1)),
    ):
        sizes.clear()
        stage()
        assert TEXTS in sizes
        assert spark.conf.get(key) == before
    with batches_of(spark, 10**6):  # never more than the session's own
        assert spark.conf.get(key) == before


def test_packing_loads_the_library_tokenizer_only_for_special_strings():
    packing._library.cache_clear()
    packing.encode(TOKENIZER, ["some text, and more", "", "two\n\nlines"])
    assert not packing._library.cache_info().currsize
    special = packing._encoder(TOKENIZER).special[0]
    assert packing.encode(TOKENIZER, [f"a {special} b"]) and packing._library.cache_info().currsize


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and 0.8 * docs.count() <= kept.count() <= docs.count()
        docs = kept
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
