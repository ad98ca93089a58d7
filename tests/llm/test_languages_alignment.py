"""Language names by compression, tokenizer alignment and source audits, against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from clickmill.llm import queries as q
from clickmill.llm.alignment import align_tokenizers, cut_diagonals, overlaps, token_groups
from clickmill.llm.divergence import audit_sources, block_gaps, terms_of
from clickmill.llm.language_id import classify, identify_languages, learn_dictionaries, letters

from .helpers import documents, edge_rows, prose

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def _held(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


# --- languages ----------------------------------------------------------------------------------


def _predict(text, dictionaries):
    import zstandard

    if text is None or not any(c.isalpha() for c in text) or not dictionaries:
        return "und", 0.0
    body, sizes = letters(text), []
    for name, content in sorted(dictionaries.items()):
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=6)
        c = zstandard.ZstdCompressor(
            level=6, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        sizes.append((sum(len(c.compress(body[k:k + 4096])) for k in range(0, len(body), 4096)), name))
    sizes.sort()
    margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][1], margin / (margin + 0.02)


def test_languages_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = {r.doc_id: r for r in docs.collect()}
    learned = learn_dictionaries(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert set(learned) == {r.lang for r in table.values()}
    assert all(len(d) <= 64 << 10 for d in learned.values())
    rows = q.QUERIES["op11_zstd_languages"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(table)
    for r in rows:
        assert r.held_out == _held(r.doc_id)
        want = _predict(table[r.doc_id].text, learned)
        assert (r.lang_pred, r.score) == (want[0], pytest.approx(want[1]))
        assert r.accepted == (r.score >= 0.5)
    out = [r for r in rows if r.held_out and len(table[r.doc_id].text) >= 100]
    right = [r.lang_pred == table[r.doc_id].lang for r in out]
    assert sum(right) / len(right) >= 0.97


def test_languages_of_odd_texts(spark):
    rows = [(k, prose(k, 80), None, "s", 0) for k in range(1, 40)]
    labelled = spark.createDataFrame(
        [(i, t if i % 2 else t[::-1], "fwd" if i % 2 else "rev", s, n) for i, t, _, s, n in rows]
        + [(100, None, "fwd", "s", 0), (101, "12 %%% 34", "none", "s", 0), (102, "", None, None, 0)],
        "doc_id long, text string, lang string, source string, score int",
    )
    got = {r.doc_id: r for r in identify_languages(labelled).collect()}
    assert len(got) == 42
    for k in (100, 101, 102):
        assert (got[k].lang_pred, got[k].score, got[k].accepted) == ("und", 0.0, False)
    assert sum(got[k].lang_pred == ("fwd" if k % 2 else "rev") for k in range(1, 40)) >= 38
    # Without labels nothing is learned; with one label everything with letters is that one.
    alone = classify(labelled, {}).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}
    one = {r.doc_id: r for r in classify(labelled, {"x": b"abc"}).collect()}
    assert one[1].lang_pred == "x" and one[1].margin == 1.0 and one[101].lang_pred == "und"
    with pytest.raises(ValueError):
        learn_dictionaries(labelled, max_languages=1)


def test_copies_fill_no_dictionary(spark):
    """A third of all rows in one text gives the same dictionary as that text once."""
    rows = [(k, prose(k, 60), "x") for k in range(30)]
    docs = documents(spark, rows).withColumn("lang", F.lit("x"))
    hot = documents(spark, rows + [(99, rows[0][1], "x")] * 300).withColumn("lang", F.lit("x"))
    assert learn_dictionaries(docs) == learn_dictionaries(hot)


# --- alignment ----------------------------------------------------------------------------------


def _ends(vocabulary, ids):
    return list(itertools.accumulate(len(vocabulary[i]) for i in ids))


def _vocabulary_bytes():
    """Bytes per id, read off the byte ranks and the pieces."""
    import base64

    import sentencepiece

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        a = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    b = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        b[i] = bytes.fromhex(p[3:5]) if p.startswith("<0x") else p.replace("▁", " ").encode()
    return a, b


def _align_all(texts):
    """Brute force: tokens by character ranges, links by all pairs near each other."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    va, vb = _vocabulary_bytes()
    out, holders = [], Counter()
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(va[i] for i in a) != raw or b"".join(vb[i] for i in b) != raw:
            out.append(([], [], [], ""))
            continue
        ends_a, ends_b = _ends(va, a), _ends(vb, b)
        links, y = [], 0
        for x, end in enumerate(ends_a):
            start = ends_a[x - 1] if x else 0
            while ends_b[y] <= start:
                y += 1
            z = y
            while z < len(b) and (ends_b[z - 1] if z else 0) < end:
                links.append((a[x], b[z]))
                z += 1
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        holders.update(set(links))
        out.append((a, b, links, ";".join(groups)))
    best = Counter()
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    return [
        (len(a), len(b), g.count(";") + bool(g), len(links),
         sum(holders[x, y] == best[x] for x, y in links), sum(holders[l] for l in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for a, b, links, g in out
    ], [g for *_, g in out]


def _figures(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_alignment_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = _align_all([r.text for r in table])
    got = {r.doc_id: _figures(r) for r in q.QUERIES["op12_merge_path_groups"](spark, SF).collect()}
    assert got == {r.doc_id: w for r, w in zip(table, want)}
    assert sum(w[0] for w in want) > 100_000


ODD = [
    None, "", "a", " ", "\n\n  x\t\ty", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ low ▁", "Ünï 中文 हिन्दी 👩‍👩‍👧",
    "  ​", "a" * 5000, "\x00\x01 z", "ﬁ ① ½ ́", "end ",
]


@pytest.mark.parametrize("chunk", [1, 1 << 24])
def test_alignment_of_odd_texts(spark, chunk):
    """Any chunk size gives the same; repeated ids and rows are documents of their own."""
    texts = ODD + [t for _, t, _ in edge_rows()] + ["again", "again"]
    docs = documents(spark, [(None if k == 3 else k // 2, t, "s") for k, t in enumerate(texts)])
    want, groups = _align_all(texts)
    a, b = q.pair_of_tokenizers()
    rows = align_tokenizers(docs, a, b, chunk_bytes=chunk).documents().collect()
    key = lambda x: (str(x[0]), x[1:])
    ids = [None if k == 3 else k // 2 for k in range(len(texts))]
    assert sorted(((r.doc_id, *_figures(r)) for r in rows), key=key) == sorted(
        ((i, *w) for i, w in zip(ids, want)), key=key)
    whole = token_groups(docs, a, b).collect()
    assert sorted(map(str, ((r.doc_id, r.groups) for r in whole))) == sorted(map(str, zip(ids, groups)))
    assert align_tokenizers(docs.where("false"), a, b).documents().count() == 0


def test_merging_by_rank_gives_the_library_ids():
    """What ``byte_ranks`` states of the file: each merge is its token's last, in the order of ids,
    and words are cut alike around every character."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    from clickmill.llm.alignment import _byte_letters
    from clickmill.llm.encoding import WORD_PATTERN

    path = public_tokenizers.path("byte_bpe_50k.json")
    letters, spec = _byte_letters(), json.load(open(path))
    assert spec["normalizer"] is None and spec["pre_tokenizer"]["use_regex"]
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i != 50256}
    for n, merge in enumerate(spec["model"]["merges"]):
        a, b = (bytes(letters[c] for c in p) for p in (merge.split(" ") if isinstance(merge, str) else merge))
        parts, rank = [bytes([x]) for x in a + b], ranks[a + b]
        assert rank == 256 + n
        while True:
            low, i = min((ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if low >= rank:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a, b]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    ranked = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    # Every character of the first plane's start, then every 37th of all; all were compared once.
    for c in [*range(0x3100), *range(0x3100, 0x110000, 37)]:
        if not 0xD800 <= c <= 0xDFFF:
            s = f" x{chr(c)}y1{chr(c)}2.{chr(c)}. {chr(c)} "
            assert ranked.encode_ordinary(s) == tok.encode(s, add_special_tokens=False).ids


def test_merge_pieces_of_any_size():
    rng = np.random.default_rng(5)
    for _ in range(40):
        top = int(rng.integers(2, 60))
        a, b = (
            np.append(np.flatnonzero(rng.random(top) < p), top) for p in rng.random(2)
        )
        want = {
            (x, y) for x in range(len(a)) for y in range(len(b))
            if max(a[x - 1] if x else -1, b[y - 1] if y else -1) < min(a[x], b[y])
        }
        for steps in (1, 2, 3, 7, 1000):
            la, lb, ca, cb = overlaps(a, b, steps)
            assert len(la) == len(want) and set(zip(la.tolist(), lb.tolist())) == want
            assert a[ca].tolist() == b[cb].tolist() == sorted(set(a) & set(b))
        cuts = cut_diagonals(a, b, np.arange(len(a) + len(b) + 1))
        merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        assert cuts.tolist() == [sum(s == 0 for _, s in merged[:d]) for d in range(len(merged) + 1)]


# --- source audit -------------------------------------------------------------------------------


def _audit(rows, least):
    """Brute force in Python integers."""
    seen, groups = defaultdict(set), defaultdict(Counter)
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        for t in terms_of(text or ""):
            seen[lang, t].add(k)
            groups[lang, source][t] += 1
        groups[lang, source] += Counter()
    out = set()
    for lang in {k for k, _ in groups}:
        terms = [t for (k, t), d in seen.items() if k == lang and len(d) >= least]
        total = Counter()
        for (k, _), c in groups.items():
            if k == lang:
                total.update(c)

        def prices(c):
            size = sum(c[t] for t in terms) + 2 * len(terms)
            return {t: 1 + 10**9 * (c[t] + 2) // size for t in terms}

        gap = lambda p, r: (p - r) ** 2 // (p + r)
        whole = prices(total)
        for (k, source), c in groups.items():
            if k != lang:
                continue
            p = prices(c)
            pairs = []
            for (l, other), d in groups.items():
                if l == lang and other != source:
                    r = prices(d)
                    pairs.append((-sum(gap(p[t], r[t]) for t in terms), other))
            told = [(-gap(p[t], whole[t]), t.decode()) for t in terms if c[t] and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(told)[:10])):
                out |= {(lang, source, part, i, -v, n + 1) for n, (v, i) in enumerate(found)}
    return out


def test_audit_against_brute_force(spark):
    rows = [("x", f"s{k % 3}", prose(k, 50)) for k in range(30)]
    rows += [(None, None, "Ä ä Aa"), (None, "b", None), ("y", "only", "a b c"), ("z", "", "q"), ("z", None, "q"),
             ("x", "none", "12 34"), ("x", "long", prose(77, 20_000))] + [("w", f"s{k % 2}", "Tie tie b") for k in range(9)]
    data = [(l, s, t, 1, 2, 3, 4) for l, s, t in rows]
    docs = spark.createDataFrame(data, "lang string, source string, text string, n int, term int, p int, value int")
    for least in (1, 3, 10):
        got = {tuple(r) for r in audit_sources(docs.repartition(5), min_documents=least).collect()}
        assert got == _audit(rows, least)
    assert audit_sources(docs.where("false")).count() == 0


def test_block_gaps_of_many_groups(monkeypatch):
    """Groups in several column blocks, prices up to the largest, give the plain sums."""
    import clickmill.llm.divergence as d

    rng = np.random.default_rng(3)
    prices = rng.choice(rng.integers(1, 10**9 + 2, 12), (40, 9))
    want = [[sum((int(p) - int(r)) ** 2 // (int(p) + int(r)) for p, r in zip(prices[:, s], prices[:, t])) if s < t else 0
             for t in range(9)] for s in range(9)]
    for width in (1, 20, 1024):
        monkeypatch.setattr(d, "COLUMNS", width)
        assert block_gaps(prices).tolist() == want
