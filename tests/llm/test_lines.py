import random
import re
from collections import defaultdict

import pytest

from tallycard.llm import lines


def brute(rows, least, share):
    """rows: (id, text, site). Kept text and numbers of each."""
    sites = defaultdict(set)
    worded = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for _, t, s in rows:
        for x in worded(t):
            if s is not None:
                sites[x].add(s)
    spread = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for i, t, _ in rows:
        own = worded(t)
        flagged = [x for x in own if x in spread]
        clean = bool(flagged) and sum(map(len, flagged)) <= share * sum(map(len, own))
        kept = "\n".join(x for x in t.split("\n") if x not in spread) if clean else t
        out.append((i, len(own), len(flagged), len(flagged) if clean else 0, kept))
    return out


@pytest.mark.parametrize("least,share", [(1, None), (3, 0.5), (8, None), (30, None)])
def test_against_brute_force(spark, odd_rows, none, least, share):
    rng = random.Random(least)
    rows = [(r[0], r[1], r[3]) for r in odd_rows]
    for i in range(200, 700):
        n = rng.randrange(1, 9)
        text = "\n".join(rng.choice([f"common {rng.randrange(12)}", f"rare {rng.random()}", "", "  ", f"near {rng.randrange(60)}"]) for _ in range(n))
        rows.append((i, text, f"site{rng.randrange(45)}" if rng.random() < 0.9 else None))
    docs = spark.createDataFrame([(*r, "a", 3, "b") for r in rows], "doc_id bigint, text string, source string, n_lines string, hits int, lines string").repartition(4)
    out = lines.without_spread_lines(docs, least_sites=least, most_share=share)
    got = out.select("row.doc_id", "n_lines", "n_flagged", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, least, share if share is not None else 1), key=repr)
    cleaned = lines.drop_spread_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


def test_empty(none):
    assert lines.drop_spread_lines(none).count() == 0 and lines.drop_spread_lines(none).columns == none.columns


def test_flagged_lines_go_whatever_their_share(spark):
    """Short pages that are mostly boilerplate lose it all the same, and keep their own lines."""
    foot = ["Accept all cookies to go on reading this page", "All rights reserved by the owner of the site", "Sign up for news"]
    rows = [(i, "\n".join([*foot, f"own {i}"]), f"site{i}") for i in range(9)] + [(20, "\n".join(foot), "site1"), (21, "own words only", "site2"), (22, None, "site3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = lines.without_spread_lines(docs, most_share=None).select("row.doc_id", "n_lines", "n_flagged", "n_removed", "kept_text").collect()
    want = [(i, 4, 3, 3, f"own {i}") for i in range(9)] + [(20, 3, 3, 3, ""), (21, 1, 0, 0, "own words only"), (22, 0, 0, 0, None)]
    assert sorted(map(tuple, got)) == want
    kept = {r["doc_id"]: r["text"] for r in lines.drop_spread_lines(docs).collect()}
    assert kept == {w[0]: w[4] for w in want}
