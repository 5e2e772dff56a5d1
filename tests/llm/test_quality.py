import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tallycard.llm import quality


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts_with_outliers(rng):
    rows = []
    for i in range(600):
        n = rng.randrange(60, 300)
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(n)]
        bad = i % 12 == 0
        if bad:
            words = [w.upper() + "###" for w in words]
        rows.append((i, " ".join(words) + "\n", "en" if i % 2 else "de", f"s{min(i % 7, 3)}", bad))
    return rows


def test_counts_and_odd_rows(odd, odd_rows, none):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality.quality_rules(odd)
    got = out.select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(r[0], *brute_counts(r[1])) for r in odd_rows], key=repr)
    assert out.filter("base_failed and kept").count() == 0 and out.filter("kept is null").count() == 0
    assert quality.quality_rules(none).count() == 0
    kept = quality.drop_rejected(odd)
    assert kept.columns == odd.columns and kept.count() == out.filter("kept").count()


def test_outliers_go_and_clean_texts_stay(spark):
    rows = texts_with_outliers(random.Random(4))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert all(kept[r[0]] != r[4] for r in rows)


def test_distances_against_numpy(spark):
    rows = texts_with_outliers(random.Random(8))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    out = quality.quality_rules(docs)
    got = {r["doc_id"]: r["distance"] for r in out.collect()}
    starts = out.selectExpr("doc_id", *[f"((xxhash64(content_key, {s}) & 9007199254740991) + 1) / 9007199254740992D as u{s}" for s in (1, 2)]).collect()
    u = {r["doc_id"]: (r["u1"], r["u2"]) for r in starts}
    groups = defaultdict(list)
    for r in rows:
        groups[r[2], r[3]].append(r)
    k, floors = 5, np.diag([f ** 2 for f in quality.STATISTICS.values()])
    for own in groups.values():
        x = []
        for r in own:
            n, chars, symbols, dup, repeat, _ = brute_counts(r[1])
            m = n + quality.PRIOR_WORDS
            caps = len(re.findall("[A-Z][A-Z]", r[1]))
            x.append([math.log((chars + quality.PRIOR_WORDS * quality.PRIOR_LENGTH) / m), math.log1p(symbols / m), math.log1p(caps / m), math.sqrt(dup / 6), repeat / m])
        x, n = np.array(x), len(own)

        def estimate(buckets, least, scale, x=x, n=n):
            least = min(n, max(least, 1))
            border = min(b for b in sorted(set(buckets)) if (buckets <= b).sum() >= least)
            part = x[buckets <= border]
            centred = part - part.mean(axis=0)
            return part.mean(axis=0), centred.T @ centred / len(part) * scale + floors

        def distance(e, x=x):
            return np.einsum("ij,jk,ik->i", x - e[0], np.linalg.inv(e[1]), x - e[0])

        cut = quality.chi2_quantile(0.75, k)
        scale = 0.75 / quality.chi2_below(cut, k + 2)
        found = []
        for s in range(3):
            b = np.zeros(n) if s == 0 else np.array([math.floor(math.log(u[r[0]][s - 1]) * quality.STEPS) for r in own])
            e = estimate(b, n if s == 0 else 6 * (k + 1), 1.0)
            for _ in range(4):
                e = estimate(np.floor(np.log(distance(e) + 1e-6) * quality.STEPS), math.ceil(n * 0.75), scale)
            found.append((np.linalg.slogdet(e[1])[1], s, e))
        e = min(found, key=lambda f: f[:2])[2]
        e = estimate((distance(e) > quality.chi2_quantile(0.975, k)).astype(int), 1, 1.0)
        want = np.sqrt(distance(e))
        assert np.allclose(want, [got[r[0]] for r in own], rtol=1e-6, atol=1e-6)


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(quality.chi2_quantile(0.75, 5) - 6.625680) < 1e-5
