import random
import re

from pyspark.sql import functions as F

from tallycard.llm import decontaminate, secret_scan, toxicity

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
NAMES = ["assign", "access", "hex"]


def brute_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def secret_texts():
    rng = random.Random(6)
    out = []
    for k in range(400):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(rng.choice([
                "plain words here", "token=", "API_KEY : '", "Password\" =  \"", "api-key", "secret:secret:", "é\U0001f600", "AKIA", "AKIAAKIA",
                "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(10, 45))), "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.randrange(8, 30))),
                "".join(rng.choice("abcXYZ019+/_.=-") for _ in range(rng.randrange(3, 30))), "\n", " ", "TOKEN =\n"]))
        out.append((k, rng.choice(["", " "]).join(parts)))
    return out


def test_base_rules_against_brute_force(spark, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + secret_texts()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, base string")
    got = secret_scan.secret_spans(docs).selectExpr("doc_id", "transform(base, s -> struct(s.start, s.kind, s.end)) as b").collect()
    flat = sorted(((r["doc_id"], [tuple(s) for s in r["b"]]) for r in got), key=repr)
    assert flat == sorted([(i, brute_base(t)) for i, t in rows], key=repr)
    digest = spark.createDataFrame(rows, "doc_id bigint, text string").select(secret_scan._written(secret_scan.base_spans(F.col("text"))).alias("w")).collect()
    assert sorted(r["w"] for r in digest) == sorted(",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in brute_base(t)) for _, t in rows)


def test_models_tell_random_from_ordinary(spark):
    rng = random.Random(9)
    prose = [(k, " ".join(rng.choice(["the", "configuration", "internationalization", "value", "user", "account", "manager", "address", "default", "of", "responsibilities"]) for _ in range(80))) for k in range(200)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = [(1000 + k, "see " + "".join(rng.choice(alphabet) for _ in range(40)) + " there") for k in range(100)]
    names = [(2000 + k, x) for k, x in enumerate(["default_user_account_manager", "internationalization-responsibilities", "configurationManagerDefaultAddress", "202401151230559871234567", "account/manager/configuration/value"])]
    docs = spark.createDataFrame(prose + secrets + names, "doc_id bigint, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["extra"]] for r in secret_scan.secret_spans(docs).collect()}
    assert sum(found[i] == [(4, 44)] for i, _ in secrets) >= 98
    assert not any(found[i] for i, _ in prose + names)


def test_secrets_of_nothing(none, odd):
    assert secret_scan.secret_spans(none).count() == 0
    assert secret_scan.secret_spans(odd).count() == odd.count()


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["you", "moron", "blarg", "grumphy" + rng.choice("abcdef")]))
            words.append(rng.choice(["moron", "blarg", "grumphyz"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(random.Random(2), 3000)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score string, id int")
    out = toxicity.score_toxicity(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"]]
    pos, neg = ([r["score"] for r in held if truth[r["doc_id"]] == y] for y in (1, 0))
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.97


def test_toxicity_without_labels_and_odd_rows(spark, odd, none):
    no = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(odd, no).collect()} == {0.0}
    assert toxicity.score_toxicity(none, no).count() == 0
    docs, labels = labelled(random.Random(3), 400)
    some = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    both = odd.select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string"))
    out = toxicity.score_toxicity(both, some)
    assert out.count() == both.count() and out.filter("score is null or held_out is null").count() == 0
    assert toxicity.text_features("", frozenset()) == (0.0,) * len(toxicity.FEATURES)


def test_common_subsequence():
    rng = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == slow(a, b)


def test_planted_items_are_found_and_clean_texts_are_not(spark, odd_rows, none, odd, monkeypatch):
    rng = random.Random(12)
    word = lambda: f"v{int(rng.paretovariate(0.6)) % 6000}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(15, 60))) + ". " + " ".join(word() for _ in range(6)) + ".") for k in range(30)]
    items += [(None, ""), (98, None), (99, items[3][1])]
    rows, truth = [], set()
    for i in range(1500):
        words = [word() for _ in range(rng.randrange(5, 400))]
        if i % 10 == 0:
            k = rng.randrange(30)
            own = items[k][1].split()
            if i % 20 == 0:  # a paraphrase: some words changed, the answer kept
                for p in range(0, len(own) - 7, 9):
                    own[p] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = own
            truth.add((i, k))
            if k == 3:
                truth.add((i, 99))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.selectExpr("doc_id + 5000 as doc_id", "text")).repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (256, 12):
        monkeypatch.setattr(decontaminate, "ITEMS", block)
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, asked).collect()}
        assert got == truth
    left = decontaminate.drop_contaminated(odd, asked)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert decontaminate.contaminated(none, asked).count() == 0
    assert decontaminate.contaminated(docs, asked.filter("item_id < 0")).count() == 0
