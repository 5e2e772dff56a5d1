"""Compression quality, importance resampling and cross-tokenizer alignment against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallycard.llm import compression, cross_tokens, resample
from tallycard.llm.bpe import vocabulary
from tallycard.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- importance resampling --------------------------------------------------


def brute_draw(docs, target, percent=25, seed=7, buckets=10000):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [" ".join(w) for w in zip(words, words[1:])]]

    found = [(i, *features(t)) for i, t in docs]
    s = Counter(b for _, _, fs in found for b in fs)
    t = Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, n, fs in found:
        w = math.floor(sum(gain[b] for b in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(tuple(r) for r in map(lambda r: [repr(x) for x in r], out))


def as_rows(df):
    return sorted(tuple(repr(x) for x in r) for r in df.collect())


def test_resample_matches_brute_force(spark, small):
    docs = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    target = [r[0] for r in duckdb.sql(f"select text from '{small}/benchmark.parquet'").fetchall()]
    want = brute_draw(docs, target)
    got = resample.resample(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet"))
    assert as_rows(got) == want
    assert as_rows(QUERIES["op13_importance_resampling"](spark, small)) == sorted(tuple(r[k] for k in (0, 2, 3, 4, 5)) for r in want)


@pytest.mark.parametrize("percent", [25, 60, 100])
def test_resample_of_odd_rows(spark, odd, odd_rows, percent):
    # repeated rows, null ids, and many rows of one id that a border may cut
    many = [(77, "the same twenty words or more in this row so that it may be drawn at all for a b c d e f g", "en", "s", 3, "x", "y", 1, "z", 2, 3)] * 9
    docs = odd.union(spark.createDataFrame(many, odd.schema))
    target = spark.createDataFrame([(1, "w1x w2x the same twenty"), (2, None)], "item_id long, text string")
    got = resample.resample(docs, target, percent=percent)
    assert as_rows(got) == brute_draw([(r[0], r[1]) for r in odd_rows + many], ["w1x w2x the same twenty", None], percent)


def test_resample_of_empty_tables(spark, odd, none):
    target = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, target).count() == 0
    assert resample.resample(odd, target).count() == odd.count()


def test_words_in_stretches():
    text = ("Ab c1-d Été x\x00y " * 50).encode()
    whole = [sorted(b for _, bs in resample.bucket_lists(text, 1000, n) for b in bs) for n in (1, 2, 3)]
    for stretch in (1, 7, 64):
        for n in (1, 2, 3):
            assert sorted(b for _, bs in resample.bucket_lists(text, 1000, n, stretch) for b in bs) == whole[n - 1]
    assert [w for ws in resample.word_lists(text, 5) for w in ws] == [w.encode() for w in WORD.findall(text.decode().translate(LOWER))]


# ---- compression quality ----------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_compression_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    rows = got.select("score", "predicted", "quality").collect()
    good, bad = [r[0] for r in rows if r[2]], [r[0] for r in rows if not r[2]]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert area > 0.95
    assert sum(r[1] == r[2] for r in rows) / len(rows) > 0.93


def test_quality_contract(spark, small):
    got = {r["doc_id"]: r for r in QUERIES["op11_compression_quality"](spark, small).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    assert len(docs) == len(got)
    for i, _ in docs:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_labels_are_never_read(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted((r["doc_id"], r["score"]) for r in compression.score_quality(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_of_odd_rows(spark, odd, none, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert compression.score_quality(none, labels).count() == 0
    for own in (labels, labels.limit(0), spark.createDataFrame([(i, i % 2) for i in range(1, 16)], "doc_id long, quality int")):
        got = compression.score_quality(odd, own).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        by_text = defaultdict(set)
        for r in got:
            by_text[r["doc_id"]].add(r["score"])
        assert by_text[1] == by_text[2] and by_text[4] == by_text[5]


def test_size_difference_reads_the_whole_text():
    good, bad = (compression.compressor(*compression.build_dictionary([w.encode() * 40 for w in ws])) for ws in (["alpha beta gamma "], ["zeta eta theta "]))
    text = b"alpha beta gamma " * 100
    assert compression.size_difference(text, good, bad) > 0
    assert compression.size_difference(text + b"zeta eta theta " * 3000, good, bad) < 0
    assert compression.size_difference(b"", good, bad) == 0


# ---- cross-tokenizer alignment ----------------------------------------------


def brute_align(docs):
    """Token by token, links spelled out."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}

    def spell(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found = []
    for i, text in docs:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_of = [[bytes(letters[c] for c in a.id_to_token(x)) for x in ids[0]], [spell(x) for x in ids[1]]]
            if b"".join(bytes_of[0]) == b"".join(bytes_of[1]) == (" " + text).encode():
                ends = [[0], [0]]
                for side in (0, 1):
                    for x in bytes_of[side]:
                        ends[side].append(ends[side][-1] + len(x))
                cuts = sorted(set(ends[0]) & set(ends[1]))
                at = [0, 0]
                for cut in cuts[1:]:
                    group = []
                    for side in (0, 1):
                        stop = ends[side].index(cut, at[side])
                        group.append(ids[side][at[side]:stop])
                        at[side] = stop
                    groups.append(group)
        found.append((i, groups))
    seen = Counter(pair for _, groups in found for pair in {(x, y) for xs, ys in groups for x in xs for y in ys})
    top = Counter()
    for (x, _), n in seen.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups in found:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(seen[p] == top[p[0]] for p in links),
                    sum(seen[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(tuple(repr(x) for x in r) for r in out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_matches_brute_force(spark, small):
    docs = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    got = QUERIES["op12_cross_tokenizer"](spark, small)
    assert got.columns == COLUMNS
    assert as_rows(got) == brute_align(docs)


@pytest.mark.parametrize("chunk, pairs", [(cross_tokens.CHUNK_BYTES, cross_tokens.BLOCK_PAIRS), (50, 40)])
def test_alignment_of_odd_rows(spark, odd, odd_rows, chunk, pairs):
    more = ["a▁b", "<s> plain </s> <unk>", " lead", "trail ", "  ", " ", "a  b   c \n d\t e", "▁", "\x00 nul", "don't  can't 's", "é̂ 　 wide"]
    rows = [(100 + k, t, "en", "s", 3, "x", "y", 1, "z", 2, 3) for k, t in enumerate(more)]
    texts = [r for r in odd_rows if len(r[1] or "") < 40_000] + rows
    docs = spark.createDataFrame(texts, odd.schema).repartition(2)
    got = cross_tokens.align(docs, vocabulary(), vocabulary("piece_bpe_32k.model"), form="digests", chunk_bytes=chunk, block_pairs=pairs)
    assert as_rows(got) == brute_align([(r[0], r[1]) for r in texts])


def test_alignment_gives_groups(spark, odd, none):
    paths = vocabulary(), vocabulary("piece_bpe_32k.model")
    assert cross_tokens.align(none, *paths).count() == 0
    digests = cross_tokens.align(odd, *paths, form="digests").select("doc_id", "n_groups", "groups_sha256").collect()
    lists = cross_tokens.align(odd, *paths, chunk_bytes=1000).select("doc_id", "n_groups", "groups").collect()

    def digest(groups):
        text = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in groups)
        return hashlib.sha256(text.encode()).hexdigest() if groups else ""

    assert sorted(map(repr, [(d, n, h) for d, n, h in digests])) == sorted(map(repr, [(d, n, digest(g)) for d, n, g in lists]))


def test_shared_ends_by_merge_as_by_join():
    """Ends that both tokenizers share are found by running byte counts, as a join on document and end finds them."""
    import numpy as np
    import pyarrow as pa

    def side(lists, widths, name):
        return cross_tokens._side(pa.array(lists, pa.list_(pa.int32())), pa.array([0, 0, 1], pa.int32()), pa.array(widths, pa.int64()), name)

    # "ab cd" and "ef": a|b| cd|ef against ab| c|d|e|f
    a = side([[0, 1], [2], [3]], [1, 1, 3, 2], "a")
    b = side([[0], [1, 2], [3, 4]], [2, 2, 1, 1, 1], "b")
    assert [x.tolist() for x in cross_tokens._shared_ends(a, b)] == [[1, 2, 3], [0, 2, 4]]
    # a token without bytes ends where the one before it does: both meet the other side's end there
    b = side([[0, 5], [1, 2], [3, 4]], [2, 2, 1, 1, 1, 0], "b")
    got = sorted(zip(*[x.tolist() for x in cross_tokens._shared_ends(a, b)]))
    assert got == [(1, 0), (1, 1), (2, 3), (3, 5)] and np.all(a["at"].to_numpy() == [1, 2, 5, 7])
