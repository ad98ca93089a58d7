"""The pipeline's stages on small tables, each against its rule in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p

from .helpers import BLANKS, documents, edge_rows, lower_ascii, prose, split_words

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    bench = prose(900, 40)
    boiler = "a line of boilerplate that more than five of the documents hold in common"
    rows = [(k, prose(k, 100) + "\n" + boiler, "s") for k in range(8)]
    near = split_words(prose(50, 200))
    rows += [(20, " ".join(near), "s"), (21, " ".join([*near[:-1], "changed"]), "s"), (22, " ".join(near), "t")]
    rows += [(30, prose(31, 40) + " " + bench + " " + prose(32, 40), "s"), (31, "too few words", "s"), (32, None, "s")]
    docs = documents(spark, rows, clashes=False)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == [
        "quality rules", "line dedup", "near-dedup", "benchmark decontamination", "packing"
    ]
    one = stages["quality rules"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == {*range(8), 20, 21, 22, 30}
    two = stages["line dedup"](spark, one, str(tmp_path))
    texts = {r.doc_id: r for r in two.collect()}
    assert boiler in texts[7].text and not any(boiler in texts[k].text for k in range(7))
    assert texts[0].n_chars == len(texts[0].text) and texts[20].text == rows[8][1]
    three = stages["near-dedup"](spark, two, str(tmp_path))
    assert {r.doc_id for r in three.collect()} == {*range(8), 20, 30}
    four = stages["benchmark decontamination"](spark, three, str(tmp_path))
    assert {r.doc_id for r in four.collect()} == {*range(8), 20}
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = stages["packing"](spark, four, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in four.collect()}
    got = {}
    for r in five:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_edge_rows_pass_through(spark, tmp_path):
    """Every stage against plain Python, row by row: null and repeated ids, null and empty texts."""
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    docs = documents(spark, edge_rows(), clashes=False)
    for name, stage in p.STAGES:
        out = stage(spark, docs.where("false"), str(tmp_path))
        assert out.count() == 0
        if name == "packing":
            break
        before, out = docs.collect(), stage(spark, docs, str(tmp_path)).cache()
        rows = {k: r for k, r in enumerate(sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id or 0)))}
        if name == "quality rules":
            want = [r.text for r in _quality(before)]
        elif name == "near-dedup":
            want = list(_near_dedup({k: r.text or "" for k, r in rows.items()}).values())
        elif name == "line dedup":
            want = list(_line_dedup({k: r.text or "" for k, r in rows.items()}).values())
        else:
            want = [r.text for r in before]
        assert sorted(str(r.text) for r in out.collect()) == sorted(map(str, want))
        assert out.columns == docs.columns
        docs = out
    assert len(docs.collect()) >= 5 and any(r.doc_id is None for r in docs.collect())
    pieces = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in pieces) == docs.count()


def test_rows_without_an_id_are_judged_one_by_one(spark, tmp_path):
    spark.createDataFrame([(1, prose(77, 40))], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    shared = "this one line is long enough and stands in each of six different documents"
    rows = [(None, prose(1, 60), "a"), (None, "too short", "a"), (None, prose(2, 60), "b"),
            (None, prose(3, 30) + " " + prose(77, 40), "b"), (7, prose(4, 60) + "\n" + shared, "a"),
            (7, prose(5, 60) + "\n" + shared, "a")]
    rows += [(k, prose(k, 60) + "\n" + shared, "c") for k in range(10, 14)]
    docs = documents(spark, rows, clashes=False)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    got = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    want = [(i or 0, t.replace("\n" + shared, "") if i != 13 else t) for i, t, _ in rows]
    assert got == sorted(w for n, w in enumerate(want) if n not in (1, 3))


def _quality(rows: list) -> list:
    """Rows that the quality stage keeps, by the rules in plain Python."""
    holders = defaultdict(set)
    hosts = defaultdict(set)
    for r in rows:
        hosts[r.source].add(r.text or "")
    for host, texts in hosts.items():
        for t in texts:
            for line in t.split("\n"):
                if line.strip(BLANKS):
                    holders[host, lower_ascii(line.strip(BLANKS))].add(t)

    def mark(t):
        return hashlib.md5(t.encode()).hexdigest()

    owner = {key: min(texts, key=mark) for key, texts in holders.items() if len(texts) >= 10}
    kept = []
    for r in rows:
        words = split_words(r.text)
        text = r.text or ""
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i:i + 8])].append(i)
        repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        lost = sum(
            len(split_words(line)) for line in text.split("\n")
            if owner.get((r.source, lower_ascii(line.strip(BLANKS))), text) != text
        )
        if len(words) >= 20 and 100 * len(repeated) <= 30 * len(words) and len(words) - lost >= 20:
            kept.append(r)
    return kept


def _line_dedup(texts: dict) -> dict:
    seen = defaultdict(set)
    for k, t in texts.items():
        for line in t.split("\n"):
            seen[lower_ascii(line.strip(BLANKS))].add(k)
    gone = {key: max(ids) for key, ids in seen.items() if len(key) >= 40 and len(ids) >= 5}
    return {
        k: "\n".join(
            line for line in t.split("\n") if gone.get(lower_ascii(line.strip(BLANKS)), k) == k
        ) for k, t in texts.items()
    }


def _near_dedup(texts: dict) -> dict:
    sets = {}
    for k, t in texts.items():
        w = split_words(lower_ascii(t))
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(texts), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 80 * len(sets[x] | sets[y]):
            i, j = find(x), find(y)
            root[max(i, j)] = min(i, j)
    return {k: t for k, t in texts.items() if find(k) == k}


def _clean(texts: dict, items: list) -> dict:
    def norm(t):
        return " " + " ".join(split_words("".join(c for c in lower_ascii(t) if c.isalnum() or c in " \n"))) + " "

    needles = [norm(i) for i in items]
    return {k: t for k, t in texts.items() if not any(n in norm(t) for n in needles)}


def test_whole_run_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in _quality(rows)}
    texts = _clean(_near_dedup(_line_dedup(texts)), items)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: [*tok.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    got, filled = defaultdict(list), defaultdict(list)
    for r in p.run(spark, SF).collect():
        got[r.doc_id].append(r)
        filled[r.sequence_id].append(r)
    assert set(got) == set(want)
    for k, ids in want.items():
        at = 0
        for r in sorted(got[k], key=lambda r: r.start):
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for parts in filled.values():
        assert sum(r.length for r in parts) <= 2048
