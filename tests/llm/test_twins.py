"""Queries against their SQL twins, and against plain Python where SQL has no form."""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from check_queries import difference, open_tables
from clickmill.llm import queries as q

from .helpers import lower_ascii, split_words

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return open_tables(SF)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {k: tok.encode(t, add_special_tokens=False).ids for k, t in texts.items()}


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, con, name):
    assert difference(q.QUERIES[name](spark, SF), con, q.ORACLES[name]) is None


def test_packing_is_exact_and_tight(spark, ids):
    pieces = q.QUERIES["op4_pack_open_windows"](spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, want in ids.items():
        want, at = [*want, 1], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            part = np.array(want[at:at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want), zlib.crc32(part))
            at += p.length
        assert at == len(want)
    total = padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total += at
        padding += 2048 - at if at & (at - 1) else 0
    assert padding < 0.01 * total


def test_token_counts(spark, texts, ids):
    rows = q.QUERIES["op8_digest_cache"](spark, SF).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    assert got == {k: (len(texts[k].encode()), len(v), len(v) > 2048) for k, v in ids.items()}


def test_near_duplicates_against_all_pairs(spark, texts):
    sets = {}
    for k, t in texts.items():
        w = split_words(lower_ascii(t))
        sets[k] = {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = q.QUERIES["op9_lsh_forest"](spark, SF).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got == {k: (len(sets[k]), find(k), find(k) == k) for k in texts}


def test_leaks_against_brute_force(spark, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()

    def norm(t):
        return [w for w in split_words("".join(c for c in lower_ascii(t) if c.isalnum() or c in " \n"))]

    want = set()
    flat = {k: " " + " ".join(norm(t)) + " " for k, t in texts.items()}
    for item in bench:
        needle = " " + " ".join(norm(item.text)) + " "
        want |= {(k, item.item_id) for k, t in flat.items() if needle in t}
    rows = q.QUERIES["op7_benchmark_leaks"](spark, SF).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        words = norm(texts[r.doc_id])[r.start:r.start + r.n_words]
        item = norm(next(b.text for b in bench if b.item_id == r.item_id))
        assert _edits(words, item) == r.distance <= 0.1 * len(item)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_scores(spark):
    """On a thousand documents; a few hundred are too few to learn a spelling from."""
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {r[0]: r[1] for r in table}
    tokens = {k: [*split_words(lower_ascii(t)), ""] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    count = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    n, v = sum(count.values()), len(count)
    rows = q.QUERIES["op10_context_mixing"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ts = tokens[r.doc_id]
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ts), n)
        assert r.n_known == sum(t in count for t in ts)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    # The held-out texts cost less than under the unigram model that treats new words alike.
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_url_rules_against_brute_force(spark):
    from clickmill.llm.url_rules import MIN_CONFIDENCE, MIN_COUNT, MIN_SUPPORT, url_parts, url_tokens
    from pyspark.sql import functions as F

    host, path = url_parts(F.col("url"))
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(
        "page_id", host.alias("host"), path.alias("path"), "url"
    ).withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url"))).collect()
    labels = {
        r.doc_id: r.quality == 0 or r.toxic == 1
        for r in spark.read.parquet(f"{SF}/labels.parquet").collect()
    }
    seen = [(set(p.tokens), labels[p.page_id]) for p in pages if p.page_id in labels and p.tokens]
    bad_share = sum(b for _, b in seen) / len(seen)

    def confident(tokens):
        """The best confidence of any token combination of a page that passes the limits."""
        best = None
        near = [tokens & t for t, _ in seen]
        sets = {frozenset(x) for x in near} | {
            frozenset(x & y) for x, y in itertools.combinations(near, 2)
        }
        for s in sets - {frozenset()}:
            hits = [b for t, b in seen if s <= t]
            bad = sum(hits)
            if bad >= max(MIN_COUNT, math.ceil(MIN_SUPPORT * len(seen))) and bad / len(hits) >= max(
                MIN_CONFIDENCE, bad_share + 1e-12
            ):
                best = max(best or 0, bad / len(hits))
        return best

    written = [("com", "/", "allow"), ("example.com", "/en/", "block"),
               ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = {r.page_id: r for r in q.QUERIES["op3_url_rules"](spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        fits = [
            (len(h) + len(s), h + s, v) for h, s, v in written
            if (p.host == h or p.host.endswith("." + h)) and p.path.startswith(s)
        ]
        r = got[p.page_id]
        if fits:
            assert (r.rule, r.verdict) == max(fits)[1:]
        else:
            best = confident(set(p.tokens))
            assert r.rule is None and r.verdict == ("block" if best else "allow")
            if best:
                # Pruned rules never lose the best confidence a page can have.
                assert r.confidence == pytest.approx(best)
