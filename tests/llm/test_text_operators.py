"""Packing, licence scans, mixing, URL filters, quality classifier, toxicity, perplexity."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvestra import store
from silvestra.llm import licenses, mixing, packing, perplexity, quality, toxic, urls
from silvestra.llm.tokens import Words

HARD = [None, "", " \n\t ", "one", "one", "Ω ß 漢字 é", "word " * 30_000, "a.b! c? d\ne"]


def test_tokens_as_split():
    texts = [t for t in HARD if t is not None] + ["A b\nc  d e", "\ttab"]
    words = Words(pa.array([*texts, None]), lower=True)
    import re

    for k, t in enumerate(texts):
        assert words.bounds[k + 1] - words.bounds[k] == len(re.findall(r"[^\t\n\f\r ]+", t))
    same = Words(pa.array(["x b", "a b", "B"]), lower=True).hash
    assert same[1] == same[3] == same[4] and same[0] != same[2]


def best_cost(sizes, penalties, length):
    """The least cost of all ways to cut, by trying each."""
    best = [0] + [math.inf] * len(sizes)
    for j in range(1, len(sizes) + 1):
        for i in range(j):
            if (n := sum(sizes[i:j])) <= length:
                best[j] = min(best[j], best[i] + length - n + penalties[j - 1])
    return best[-1]


def test_cuts_are_best():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 25))]
        penalties = [rng.choice([0, 3, 9]) for _ in sizes]
        at = packing.cuts(sizes, penalties, 12)
        cost, i = 0, 0
        for j in at:
            n = sum(sizes[i:j])
            assert n <= 12
            cost, i = cost + 12 - n + penalties[j - 1], j
        assert i == len(sizes) and cost == best_cost(sizes, penalties, 12)


def sentences(text):
    """Lengths of a text's sentences."""
    out, n = [], 0
    for line in text.split("\n"):
        for w in line.split():
            n += 1
            if w[-1] in ".!?":
                out.append(n)
                n = 0
        if n:
            out.append(n)
            n = 0
    return out


def test_packing_is_best_and_whole(docs_of):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{k}{rng.choice(['', '', '.', chr(10)])}" for _ in range(rng.randint(0, 40)))) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(HARD)] + [(None, "null id."), (3, rows[3][1]), (200, "x " * 70)]
    length = 30
    got = sorted(packing.packed(docs_of(rows), length).collect(), key=lambda r: (r["shard"], r["window"]))
    assert {r["shard"] for r in got} == {0}
    spans = defaultdict(list)
    for r in got:
        assert sum(b - a for a, b in zip(r["starts"], r["stops"], strict=True)) == r["n_tokens"] == length - r["padding"] <= length
        for d, a, b in zip(r["doc_ids"], r["starts"], r["stops"], strict=True):
            spans[d].append((a, b))
    full = Counter()
    for i, t in rows:
        full[i] += len((t or "").split())
    for i, n in full.items():
        assert sum(b - a for a, b in spans[i]) == n
    sizes, penalties = [], []
    for i, t in sorted(((i, t) for i, t in rows if t and t.split()), key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = [(length if k else n - (-(-n // length) - 1) * length, packing.SENTENCE if k == 0 else packing.HARD) for n in sentences(t) for k in range(-(-n // length) - 1, -1, -1)]
        sizes += [p[0] for p in parts]
        penalties += [p[1] for p in parts[:-1]] + [0]
    cut = sum(packing.HARD if _inside(rows, r) else packing.SENTENCE for r in got if _splits(rows, r))
    assert sum(r["padding"] for r in got) + cut == best_cost_fast(sizes, penalties, length)
    assert packing.packed(docs_of(rows).limit(0)).count() == 0


def _text_of(rows, i):
    return next(t for j, t in rows if j == i and t and t.split())


def _splits(rows, r):
    return r["stops"][-1] < len(_text_of(rows, r["doc_ids"][-1]).split())


def _inside(rows, r):
    return r["stops"][-1] not in np.cumsum(sentences(_text_of(rows, r["doc_ids"][-1])))


def best_cost_fast(sizes, penalties, length):
    best = [0] + [math.inf] * len(sizes)
    for j in range(1, len(sizes) + 1):
        n = 0
        for i in range(j - 1, -1, -1):
            n += sizes[i]
            if n > length:
                break
            best[j] = min(best[j], best[i] + length - n + penalties[j - 1])
    return best[-1]


def test_packing_in_shards(docs_of):
    rows = [(k * 3, "a b c. " * (k % 9)) for k in range(300)]
    got = packing.packed(docs_of(rows), 16, shard_tokens=200).collect()
    assert len({r["shard"] for r in got}) > 5
    for shard in {r["shard"] for r in got}:  # each shard is packed as well as it can be
        own = [r for r in got if r["shard"] == shard]
        spans = sorted((d, a, b) for r in own for d, a, b in zip(r["doc_ids"], r["starts"], r["stops"], strict=True))
        counts = Counter()
        for d, a, b in spans:
            counts[d] += b - a
        pieces = [(3, packing.SENTENCE) if k + 1 < n // 3 else (3, 0) for _, n in sorted(counts.items()) for k in range(n // 3)]
        cut = sum(packing.SENTENCE for r in own if r["stops"][-1] < counts[r["doc_ids"][-1]])
        assert sum(r["padding"] for r in own) + cut == best_cost_fast([p[0] for p in pieces], [p[1] for p in pieces], 16)
    assert sum(r["n_tokens"] for r in got) == sum(3 * (k % 9) for k in range(300))


def test_packing_of_skewed_ids(docs_of):
    """One far id, a third of all rows with one id, and null ids: shards stay small."""
    text = "a b c d e. " * 4
    rows = [(k, text) for k in range(100)] + [(7, text)] * 100 + [(None, text)] * 50 + [(1 << 60, text), (-(1 << 60), text)]
    got = packing.packed(docs_of(rows), 64, shard_tokens=400).collect()
    tokens = Counter()
    for r in got:
        tokens[r["shard"]] += r["n_tokens"]
    assert sum(tokens.values()) == 20 * len(rows) and max(tokens.values()) <= 420 and len(tokens) == -(-20 * len(rows) // 400)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for k, y in enumerate(b):
            row[k + 1] = old[k] + 1 if x == y else max(old[k + 1], row[k])
    return row[-1]


def test_alignment_against_lcs():
    rng = random.Random(3)
    for _ in range(200):
        template = [f"t{k}" for k in range(rng.randint(1, 20))]
        text = [w for w in template if rng.random() < 0.9]
        for _ in range(rng.randint(0, 6)):
            text.insert(rng.randint(0, len(text)), f"x{rng.randrange(5)}")
        pairs = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == lcs(text, template)  # words of the template differ: patience is the longest
    same = licenses.align("a b a b c".split(), "a b a b c".split())
    assert len(same) == 5


def test_licenses(docs_of):
    mit, noise = licenses.TEMPLATES["MIT-full"], "the of and to in is that this license is under " * 400
    rows = [(1, f"{noise}\nReleased under the MIT License."), (2, "Released under the MIT License.\n" * 3), (3, f"intro {mit} end"), (4, mit.upper().replace(" ", "\n")), (5, noise), (6, "released under the license of MIT"), (7, "Licensed under the Apache License, Version 2.0.")]
    rows += [(20 + k, t) for k, t in enumerate(HARD)] + [(None, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0.")]
    got = sorted((str(r["doc_id"]), r["license"], r["coverage"]) for r in licenses.scanned(docs_of(rows)).collect())
    assert got == sorted([("1", "MIT", 1.0), ("2", "MIT", 1.0), ("3", "MIT-full", 1.0), ("4", "MIT-full", 1.0), ("7", "Apache-2.0", 1.0), ("None", "CC-BY-NC-4.0", 1.0), ("1", "CC-BY-NC-4.0", 1.0), ("6", "MIT", 0.8)])
    made = [licenses.Template(n, t) for n, t in licenses.TEMPLATES.items()]
    words = mit.split()
    for drop in (0, 5, 10):
        hit = licenses.licenses_in(" ".join(w for k, w in enumerate(words) if k % 20 != drop), made)
        assert [h[0] for h in hit] == ["MIT-full"] and hit[0][1] >= 0.9
    assert licenses.scanned(docs_of(rows).limit(0)).count() == 0


def test_licenses_by_name_and_whole(docs_of):
    gpl, agpl, lgpl = (licenses.TEMPLATES[f"{n}-notice"] for n in ("GPL-3.0", "AGPL-3.0", "LGPL-2.1"))
    whole = [n for n in licenses.TEMPLATES if n.endswith("-full")]
    texts = ["Released under the BSD License", "Released under the Apache License", "Licensed under the MIT of the", gpl, agpl, lgpl, gpl.replace("version 3", "version 2"), *(f"before\n{licenses.TEMPLATES[n]}\nafter" for n in whole)]
    got = [{r["license"] for r in licenses.scanned(docs_of(texts)).where(f"doc_id = {k}").collect()} for k in range(7)]
    assert got == [{"BSD"}, set(), set(), {"GPL-3.0-notice"}, {"AGPL-3.0-notice"}, {"LGPL-2.1-notice"}, {"GPL-2.0-notice"}]
    found = {(r["doc_id"], r["license"]) for r in licenses.scanned(docs_of(texts)).collect()}
    assert {"GPL-3.0-full", "LGPL-3.0-full", "MPL-2.0-full", "BSL-1.0-full"} <= set(whole)
    for k, n in enumerate(whole, 7):
        assert (k, n) in found and not any((k, m) in found for m in whole if m != n)


@pytest.mark.parametrize("coverage", [0.5, 0.8, 1.0])
def test_license_scan_against_brute_force(docs_of, coverage):
    """Edited copies of templates of different words, among other words: found as the longest common subsequence says."""
    rng = random.Random(6)
    templates = {f"T{k}": " ".join(f"t{k}x{j}" for j in range(n)) for k, n in enumerate((6, 12, 40))}
    texts = ["", None, "word " * 3000]
    for _ in range(150):
        parts = [[f"noise{rng.randrange(50)}" for _ in range(rng.randint(0, 90))] for _ in range(3)]
        for t in templates.values():
            if rng.random() < 0.6:
                copy = [x for x in t.split() if rng.random() < rng.choice([1, 0.9, 0.6])]
                for _ in range(rng.randint(0, 5)):
                    copy.insert(rng.randint(0, len(copy)), "other")
                parts.append(copy)
        rng.shuffle(parts)
        texts.append(" ".join(w for part in parts for w in part))
    want = set()
    for k, text in enumerate(texts):
        for name, t in templates.items():
            own = t.split()
            at = [i for i, x in enumerate((text or "").split()) if x in own]
            words, n = [(text or "").split()[i] for i in at], lcs([(text or "").split()[i] for i in at], own)
            if words and n / len(own) >= coverage - 1e-9 and n / (at[-1] - at[0] + 1) >= 0.3:
                want.add((k, name, round(n / len(own), 6)))
    got = {(r["doc_id"], r["license"], r["coverage"]) for r in licenses.scanned(docs_of(texts), templates, coverage, 0.3).collect()}
    assert got == want and len(want) > 20


def test_mixing_against_brute_force(docs_of):
    import hashlib

    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(0, 30)) for k in range(400)] + [(7, "w w"), (None, "a b"), (None, "a b"), (900, None), (901, "")]
    sources = [rng.choice(["a", "b", None]) for _ in rows]
    docs = docs_of(rows, sources=sources).withColumn("weight", F.when(F.col("doc_id") % 3 == 0, 2.0).when(F.col("doc_id") % 7 == 1, None).otherwise(0.5))
    targets, budget = {"a": 3.0, "b": 1.0}, 1.7
    got = Counter()
    for r in mixing.mixture(docs, F.col("weight"), targets, budget).collect():
        got[r["doc_id"], r["source"], r["n_tokens"]] += r["copies"]
    total = sum(len((t or "").split()) for _, t in rows)
    want = Counter()
    for s, share in targets.items():
        own = []
        for (i, t), src in zip(rows, sources, strict=True):
            n = len((t or "").split())
            if src == s and n:
                u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                w = 2.0 if i is not None and i % 3 == 0 else 1.0 if i is not None and i % 7 == 1 else 0.5
                own.append((-math.log(u) / w, -1 if i is None else i, n, i))
        size = sum(x[2] for x in own)
        tokens = math.floor(budget * total_with(rows) * share / 4)
        epochs, rest = divmod(tokens, size)
        groups, upto = defaultdict(list), 0
        for x in sorted(own):
            groups[x[:3]].append(x)
        for g in sorted(groups):
            upto += sum(x[2] for x in groups[g])
            for x in groups[g]:
                want[x[3], s, x[2]] += epochs + (upto <= rest)
    assert total and got == Counter({k: v for k, v in want.items() if v})
    out = mixing.mixed(docs, F.col("weight"), targets, budget)
    assert out.columns == docs.columns and out.count() == sum(got.values())
    assert mixing.mixture(docs.limit(0), F.lit(1.0)).count() == 0


def total_with(rows):
    return sum(len((t or "").split()) for _, t in rows)


def test_url_keys_and_cascade(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    listed = rng.random(20_000) < 0.3
    assert (urls.listed_by(urls.cascade(keys[listed], keys[~listed]), keys) == listed).all()
    assert urls.cascade(keys[:0], keys) == b"" and not urls.listed_by(b"", keys).any()
    assert urls.listed_by(urls.cascade(keys, keys[:0]), keys).all()


@pytest.mark.parametrize("limit", [urls.BROADCAST_BYTES, -1])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(urls, "SHARD_KEYS", 20)
    rows = [(k, f"https://{h}/p{k % 40}?q={k}#x", "s", "a") for k, h in enumerate(["bad.org", "www.good.org", "sub.BAD.org", "notbad.org"] * 50)] + [(None, "http://bad.org/", "s", "a"), (5, None, "s", "a"), (6, "", "s", "a"), (6, "", "s", "a"), (7, "ü:// ", "s", "a"), (8, "x" * 100_000, "s", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, shard string, key string")
    got = urls.filtered(pages, ("bad",)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["listed"] == ("bad" in (r["url_key"] or "").split("/")[0].split("."))
    assert sum(r["listed"] for r in got) == 101
    table = spark.createDataFrame([("HTTP://bad.org/p0/index.html",), ("bad.org/p4",), ("bad.org/p4?x",), ("nowhere.org/p1",), (None,), ("",)], "url string")
    got = urls.filtered_by(pages, table).collect()
    assert len(got) == len(rows) and {r["url_key"] for r in got if r["listed"]} == {"bad.org/p0", "bad.org/p4"}
    assert urls.filtered(pages.limit(0)).count() == 0


def test_features_and_score_against_brute_force(docs_of, spark):
    """Features of each text by plain loops, and the score with all pairs written out."""
    texts = [t for t in HARD if t is None or len(t) < 1000] + ["Buy now! Cheap, 50% off.\nCall 555 1234 today.", "Der Fluß fließt ruhig. " * 9, "x"]
    rng = np.random.default_rng(5)
    machine = quality.Machine(0.1, rng.normal(0, 0.3, quality.SIZE).astype(np.float32), rng.normal(0, 0.3, (quality.SIZE, quality.RANK)).astype(np.float32))

    def brute(text, lang, source):
        text = text or ""
        raw, split = text.encode(), text.split()
        number = lambda w: int(Words(pa.array([w]), lower=True).hash[0]) % quality.BUCKETS
        distinct = {number(w) for w in split}
        share = lambda chars: sum(c in chars for c in raw) / max(1, len(raw))
        small, digits, capitals = b"abcdefghijklmnopqrstuvwxyz\t\r ,'-", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        other = bytes(c for c in range(128) if c not in small + digits + capitals + b".!?\n")
        stats = {"signs": share(other), "digits": share(digits), "capitals": share(capitals), "not_ascii": share(bytes(range(128, 256))), "ends": share(b".!?"), "lines": share(b"\n"), "word_length": sum(len(w.encode()) for w in split) / max(1, len(split)), "distinct": len(distinct) / max(1, len(split)), "words": len(split)}
        x, base = {k: 1 / math.sqrt(len(distinct)) for k in distinct}, quality.BUCKETS
        for name, edges in quality._BINS.items():
            x[base + sum(e <= stats[name] for e in edges)] = quality._STATISTIC
            base += len(edges) + 1
        for k, (value, salt) in enumerate(((lang, 1), (source, 2))):
            x[base + 1024 * k + int(quality._hashed(pa.array([value], pa.string()), salt)[0])] = quality._META
        raw = machine.bias + sum(machine.weights[i] * v for i, v in x.items())
        items = list(x.items())
        for k, (i, v) in enumerate(items):
            raw += sum(float(machine.factors[i] @ machine.factors[j]) * v * w for j, w in items[k + 1 :])
        return 1 / (1 + math.exp(-raw))

    langs, sources = ([["en", "de", None][k % 3] for k in range(len(texts))], ["s"] * len(texts))
    for r in quality.classified(docs_of(texts, langs=langs, sources=sources), machine).collect():
        assert abs(r["score"] - brute(texts[r["doc_id"]], langs[r["doc_id"]], "s")) < 1e-4, texts[r["doc_id"]]


def test_machine_identity():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32))
    index, value = rng.choice(quality.SIZE, 14, False), rng.random(14).astype(np.float32)
    for a, b in ((0, 9), (9, 14)):
        i, x = index[a:b], value[a:b]
        whole = 0.3 + sum(m.weights[i] * x) + sum(m.factors[i[p]] @ m.factors[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(m.parts(index, value, np.array([0, 9, 14]))[0][int(a > 0)] - whole) < 1e-3


def test_quality_held_out(docs_of, spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["buy", "now", "$$$", "!!!", "cheap"] if k % 3 == 0 else ["tree", "river", "walks", "blue", "stone"]) + rng.choice(["", ".", ","]) for _ in range(rng.randint(8, 40)))) for k in range(600)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(None, 1, 0), (5, None, 0), (6, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    machine = quality.machine_for(docs, labels)
    got = {r["doc_id"]: r for r in quality.classified(docs, machine).collect()}
    held = [got[k]["keep"] == (k % 3 > 0) for k in range(400, 600)]
    assert sum(held) >= 0.95 * len(held)
    hard = docs_of(HARD + [(None, "tree river")], langs=[None] * (len(HARD) + 1), sources=[None] * (len(HARD) + 1))
    assert all(0 <= r["score"] <= 1 for r in quality.classified(hard, machine).collect()) and quality.classified(hard, machine).count() == len(HARD) + 1
    assert all(r["keep"] for r in quality.classified(hard, quality.machine_for(hard, labels.limit(0))).collect())
    assert quality.classified(hard.limit(0), machine).count() == 0


def test_toxicity(docs_of, spark):
    lexicon = {"idiot": 1.0, "scum": 1.0, "clown": 0.5}
    m = toxic.Matcher(lexicon)
    assert m.hits("You 1D10T, іdiot! sсum pond scum clownish") == [1.0, 1.0, 1.0]
    assert m.hits(None) == [] and m.hits("") == [] and m.hits("the clown fish") == []
    brute = lambda t: sum(toxic.fold("".join(c for c in w.lower() if c.isalnum())) in lexicon for w in t.split())
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["idiot", "Id1ot", "sky", "clown,", "blue", "5cum!", "idiots"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    assert all(len(m.hits(t)) == brute(t) for t in texts)
    docs = docs_of(HARD + ["idiot scum", (None, "idiot scum")])
    got = toxic.toxicity(docs, lexicon).collect()
    assert len(got) == len(HARD) + 2 and sum(r["toxic"] for r in got) == 2
    assert toxic.without_toxic(docs, lexicon).count() == len(HARD) and toxic.without_toxic(docs, lexicon).columns == docs.columns
    assert toxic.toxicity(docs.limit(0), lexicon).count() == 0
    labels = spark.createDataFrame([(k, 1, int(k < 20)) for k in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    learned = toxic.learned_lexicon(docs_of([f"grubby{k} zorkel thing" if k < 20 else f"nice{k} thing" for k in range(60)]), labels)
    assert "zorkel" in learned and "thing" not in learned
    assert toxic.learned_lexicon(docs, labels.limit(0)) == {}


def kneser_ney(texts):
    """A model of the same definition by plain dictionaries: ln P of each token of a text."""
    split = [(t or "").lower().split() for t in texts]
    pairs = Counter((a, b) for t in split for a, b in zip(["<s>", *t], t, strict=False))
    follow, ends = Counter(), Counter()
    for (a, b), n in pairs.items():
        follow[a] += n
        ends[b] += 1
    d = perplexity.discounts(np.array([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
    e = perplexity.discounts(np.array([sum(n == k for n in ends.values()) for k in (1, 2, 3, 4)]))
    share = {p: (n - d[min(n, 3) - 1]) / follow[p[0]] for p, n in pairs.items() if n > 1}
    left = defaultdict(lambda: 1.0)
    for (a, _), s in share.items():
        left[a] -= s
    lower = {b: (n - e[min(n, 3) - 1]) / sum(ends.values()) for b, n in ends.items()}
    spare = (1 - sum(lower.values())) / len(lower)

    def log_p(text):
        t = (text or "").lower().split()
        return [math.log(share.get((a, w), 0) + left[a] * (lower[w] + spare)) for a, w in zip(["<s>", *t], t, strict=False)]

    return log_p


@pytest.mark.parametrize(("chunk", "n_buckets"), [(2_000_000, 4), (300, 13)])
def test_perplexity_against_dictionaries(docs_of, monkeypatch, chunk, n_buckets):
    """With one chunk and many, and a very long text."""
    monkeypatch.setattr(perplexity, "buckets_for", lambda n_bytes: n_buckets)
    rng = random.Random(9)
    texts = HARD + [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(1, 50))) for _ in range(150)]
    texts += texts[-3:]
    log_p = kneser_ney(texts)
    got = perplexity.scored(docs_of(texts), chunk).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        want = log_p(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want) and (r["log_ppl"] is None if not want else abs(r["log_ppl"] + sum(want) / len(want)) < 1e-4)


def test_toxicity_disguised():
    m = toxic.Matcher({"clown": 1.0, "loser": 0.5, "moron": 1.0, "worthless": 1.0, "imbécil": 1.0})
    for text, n in (("c1own", 1), ("1oser and worth1ess", 2), ("c|own!", 1), ("m0r0n", 1), ("m o r o n", 1), ("m.o.r.o.n", 1), ("mo\u200bron", 1), ("mo\u0301ron", 1), ("IMBÉCIL imbecil", 2), ("ｍｏｒｏｎ", 1), ("a b c d e", 0), ("clowns", 0), ("class clown, c1ass c1own", 0), ("", 0)):
        assert len(m.hits(text)) == n, text


def test_toxicity_of_many_exceptions_is_fast():
    import time

    began = time.perf_counter()
    assert toxic.Matcher({"trash": 1.0}).hits("trash can " * 100_000 + "trash") == [1.0]
    assert time.perf_counter() - began < 5


def test_toxicity_null_lang_and_all_labels(docs_of, spark):
    """Labels of a null language teach as well, however many there are; exact copies count once."""
    labels = spark.createDataFrame([(k, 1, int(k < 20)) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = docs_of([f"grubby{k} zorkel thing" if k < 20 else f"nice{k} thing" for k in range(60)], langs=[None] * 60)
    assert "zorkel" in toxic.learned_lexicon(docs, labels)
    same = docs_of(["zorkel same text" if k < 20 else f"nice{k} thing" for k in range(60)])
    assert "zorkel" not in toxic.learned_lexicon(same, labels)


def brute_keeps(texts, langs):
    """Verdicts by the same bands, from the model of dictionaries."""
    log_p, ppl = kneser_ney(texts), {}
    for k, t in enumerate(texts):
        want = log_p(t)
        ppl[k] = (-sum(want) / len(want), len(want)) if want else None
    out = {}
    for lang in set(langs):
        own = [k for k in ppl if langs[k] == lang and ppl[k]]
        middle = lambda x: sorted(x)[(len(x) - 1) // 2]
        mid = middle([ppl[k][0] for k in own]) if own else 0
        spread = middle([abs(ppl[k][0] - mid) for k in own]) * 1.4826 if own else 0
        for k in ppl:
            if langs[k] == lang:
                slack = perplexity.NOISE / math.sqrt(ppl[k][1]) if ppl[k] else 0
                out[k] = not ppl[k] or perplexity.LOW * mid - slack <= ppl[k][0] <= mid + perplexity.HIGH * spread + slack
    return out


def test_perplexity_bands_against_brute_force(docs_of):
    rng = random.Random(12)
    texts = [" ".join(f"w{min(rng.randrange(80), rng.randrange(80))}" for _ in range(rng.choice([5, 60, 300]))) for _ in range(120)]
    texts += [" ".join(f"q{k}.{rng.random()}" for k in range(n)) for n in (3, 40, 200)] + ["odd " * n for n in (3, 300)] + HARD
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    got = {r["doc_id"]: r["keep"] for r in perplexity.judged(docs_of(texts, langs=langs)).collect()}
    assert got == brute_keeps(texts, langs) and not all(got.values())


def test_perplexity_rules(docs_of):
    rng = random.Random(10)
    texts = [" ".join(f"w{min(rng.randrange(80), rng.randrange(80))}" for _ in range(60)) for _ in range(200)] + ["odd " * 300, " ".join(f"q{k}" for k in range(200))] + HARD[:3]
    got = {r["doc_id"]: r for r in perplexity.judged(docs_of(texts, langs=["en"] * 202 + [None] * 3)).collect()}
    assert all(got[k]["keep"] for k in range(200)) and not got[200]["keep"] and not got[201]["keep"]
    assert all(got[k]["keep"] and got[k]["perplexity"] is None for k in (202, 203, 204))
    assert perplexity.judged(docs_of(texts).limit(0)).count() == 0


def test_perplexity_has_no_cap(docs_of):
    """A bigram of two occurrences has its own probability, however many tokens there are."""
    texts = ["a " * 100_000] * 45 + ["rare pair", "rare pair", "rare other", "some pair"]
    got = {r["doc_id"]: r["log_ppl"] for r in perplexity.scored(docs_of(texts)).collect()}
    log_p = kneser_ney(texts)
    assert all(abs(got[k] + sum(log_p(texts[k])) / 2) < 1e-4 for k in range(45, 49)) and got[45] < got[47]


def test_packed_keys():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert (perplexity.unpacked(perplexity.packed(keys)) == keys).all()


def test_released_shuffle_files_are_gone(spark):
    """What a stored table was exchanged through is on no disk any more when the next step begins."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    store.released(spark)
    before = disk.getAllFiles().size()
    for _ in range(4):
        path = store.stored(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
        store.released(spark)
        store.deleted(spark, path)
        assert disk.getAllFiles().size() <= before
