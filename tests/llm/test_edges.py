"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clickmill.llm.chat import assemble, rotate_perspectives
from clickmill.llm.encoding import TokenizerFile, WholeEncoder, WordEncoder
from clickmill.llm.leaks import find_leaks
from clickmill.llm.line_quality import judge_documents
from clickmill.llm.line_runs import LineRuns, drop_repeated_lines, keyed_lines, line_counts
from clickmill.llm.lsh_forest import near_duplicates
from clickmill.llm.mixing import score_documents
from clickmill.llm.packing import pack_documents
from clickmill.llm.repeats import drop_repeated_passages
from clickmill.llm.token_cache import TokenCache, count_tokens
from clickmill.llm.url_rules import judge_urls, url_tokens

from .helpers import documents, edge_rows, prose, split_words

SPEC = TokenizerFile(public_tokenizers.path("word_bpe_49k.json"), blank_free=True)

OPERATORS = {
    "lines": lambda d: drop_repeated_lines(d),
    "packing": lambda d: pack_documents(d, SPEC),
    "passages": lambda d: drop_repeated_passages(d),
    "quality": lambda d: judge_documents(d),
    "leaks": lambda d: find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "tokens": lambda d: count_tokens(d, SPEC),
    "near": lambda d: near_duplicates(d, words=3, similarity=85),
    "scores": lambda d: score_documents(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, edge_rows()).repartition(3).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["lines", "passages", "quality", "tokens", "near", "scores"])
def test_every_row_is_answered(docs, name):
    got = OPERATORS[name](docs).select("doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in edge_rows())


def test_long_line_document(spark):
    text = "\n".join(f"line number {k} of the very long text, with some words more" for k in range(20_000))
    rows = [(k, text + f"\nown line {k} of this document that nobody shares", "a") for k in range(6)]
    got = {r.doc_id: r for r in drop_repeated_lines(documents(spark, rows)).collect()}
    assert got[5].n_dropped == 0 and got[5].n_lines == 20_001
    assert all(got[k].n_dropped == 20_000 for k in range(5))
    assert got[0].kept_text == "own line 0 of this document that nobody shares"


def test_line_runs_in_batches(spark):
    """Any number of batches and any fan-out give the counts of one pass."""
    docs = documents(spark, [(k, prose(k % 7, 60), "a") for k in range(60)]).select("doc_id", "text")
    keyed = keyed_lines(docs, 10)
    want = {(r.h1, r.h2): (r.n_docs, r.last_doc) for r in line_counts(keyed).collect()}
    runs = LineRuns(spark, fan_out=2, buckets=3)
    for low in (40, 25, 10, 5, 0):
        high = {40: 60, 25: 40, 10: 25, 5: 10, 0: 5}[low]
        part = line_counts(keyed.where(f"doc_id >= {low} and doc_id < {high}"))
        fresh = {(r.h1, r.h2) for r in runs.unseen(part).collect()}
        assert all(want[k][1] < high and want[k][1] >= low for k in fresh)
        runs.add(part)
    assert sum(map(len, runs.levels)) <= 3
    got = {(r.h1, r.h2): (r.n_docs, r.owner) for r in runs.compact().collect()}
    assert got == want


def test_line_merge_needs_no_shuffle(spark):
    docs = documents(spark, [(k, prose(k, 60), "a") for k in range(20)]).select("doc_id", "text")
    runs = LineRuns(spark, fan_out=9, buckets=3)
    for k in (0, 1):
        runs.add(line_counts(keyed_lines(docs.where(F.col("doc_id") % 2 == k), 10)))
    one, two = runs.runs()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = one.join(two, ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_repeated_passages(spark):
    shared = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c " + shared + " d", "s"), (2, shared + " tail", "s"), (3, "x " * 100, "s"), (4, None, "s")]
    for chunk, bucket in ((1 << 20, 1 << 20), (10, 40)):
        got = drop_repeated_passages(
            documents(spark, rows), chunk_bytes=chunk, bucket_bytes=bucket
        ).collect()
        kept = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got}
        assert kept == {1: (64, 60, "a b c d"), 2: (61, 60, "tail"), 3: (100, 100, ""), 4: (0, 0, "")}
        assert next(r for r in got if r.doc_id == 1).spans[0].asDict() == {"start": 3, "end": 63}


def test_cache_is_used(spark, docs):
    cache = TokenCache(spark)
    first = sorted(map(str, count_tokens(docs, SPEC, cache).collect()))
    stored = cache.counts(SPEC.version()).count()
    files = spark.read.parquet(cache.path).count()
    assert sorted(map(str, count_tokens(docs, SPEC, cache).collect())) == first
    assert cache.counts(SPEC.version()).count() == stored
    assert spark.read.parquet(cache.path).count() == files
    assert cache.counts("other").count() == 0


def test_word_encoder_equals_library():
    texts = [t or "" for _, t, _ in edge_rows()] + [
        "İstanbul İ. naïve, ﬁń é  x y\x1cz \x85 don't DON'T 3.14 a.b. ...,, <|startoftext|>x "
        "<|ENDOFTEXT|> <|endoftext|>. ǅ ß ΑΣ ΑΣ. 中文 हिन्दी क्‍ष 👩‍👩‍👧 ́a",
    ]
    whole = WholeEncoder(SPEC).ids(texts)
    own = WordEncoder(SPEC)
    for _ in range(2):  # the second time from memory
        assert [a.tolist() for a in own.ids(texts)] == [b.tolist() for b in whole]
    assert own.counts(texts) == [len(i) for i in whole]
    long = "lorem ipsum, dolor\n" * 400_000
    assert own.counts([long])[0] == 400_000 * own.counts(["lorem ipsum, dolor\n"])[0]


def test_chat_edges(spark):
    rows = [
        (1, 2, "bob", "second"), (1, 1, "ann", "first"), (1, None, None, None), (1, 2000, "bob", "far"),
        (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (None, 0, "ann", "lost"),
    ]
    turns = spark.createDataFrame(
        [(*r, 1, 2) for r in rows],
        "conv_id long, turn long, role string, text string, position int, assistant int",
    )
    got = {(r.conv_id, r.assistant): r for r in assemble(rotate_perspectives(turns)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = got[(1, "ann")]
    assert ann.rendered == (
        "<|user name=unknown|>\n<|end|>\n<|assistant|>\nfirst<|end|>\n"
        "<|user name=bob|>\nsecond<|end|>\n<|user name=bob|>\nfar<|end|>\n"
    )
    learned = [[ann.rendered[m.start:m.end] for m in ann.masks]]
    assert learned == [["first<|end|>\n"]]
    bob = got[(1, "bob")]
    assert [bob.rendered[m.start:m.end] for m in bob.masks] == ["second<|end|>\n", "far<|end|>\n"]
    assert rotate_perspectives(turns.where("false")).count() == 0


def test_lines_above_the_limit_of_a_large_host(spark):
    """Ten texts suffice on a host of two thousand, and the text comes back without the line."""
    shared = "menu home news contact about legal terms privacy help more"
    rows = [(k, (shared + "\n" if k < 15 else "") + prose(k, 25) + f"\n own {k}", "big") for k in range(2000)]
    rows += [(5000 + k, shared + "\n" + prose(9000 + k, 25), "small") for k in range(9)] + [(None, None, None)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in judge_documents(docs, with_text=True).collect()}
    assert len(got) == len(rows)
    hit = [k for k in range(15) if got[k].n_removed_words == 10]
    assert len(hit) == 14 and all(got[k].cleaned_text == rows[k][1].split("\n", 1)[1] for k in hit)
    for i, t, _ in rows:
        if i not in hit:
            assert got[i].n_removed_words == 0 and got[i].cleaned_text == (t or "")


def test_long_labelled_urls_do_not_widen_the_search(spark):
    """Forty words on one bad page, and on a whole family of pages, are one item or none."""
    alone = "https://bad.example.org/" + "/".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    family = [f"https://shop.test/{'/'.join('tpl' + chr(97 + k) for k in range(25))}/{i}" for i in range(30)]
    mixed = [f"https://ok.test/{'/'.join('w' + chr(97 + k) for k in range(26) if (i * 2654435761 >> k) & 1)}" for i in range(200)]
    urls = [alone, *family, *mixed]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id long, url string, tokens int")
    labels = spark.createDataFrame(
        [(k, int(k > 30 and k % 3 > 0), 0, "x") for k in range(len(urls))],
        "doc_id long, quality int, toxic int, bad string")
    got = {r.page_id: r for r in judge_urls(pages, labels).collect()}
    assert got[0].verdict == "allow" and got[0].confidence is None
    assert all(got[k].verdict == "block" and got[k].confidence == 1.0 for k in range(1, 31))


def test_no_rule_is_lost_to_long_urls(spark):
    """Bad only where two words meet: found with any number of items a row may give to FP-growth."""
    urls = [f"https://a.test/{'/'.join('w' + chr(97 + k) for k in range(8) if (i * 2654435761 >> k) & 1)}" for i in range(160)]
    bad = ["/wb" in u and "/wg" in u for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not b), 0) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    whole, cut = ({r.page_id: r for r in judge_urls(pages, labels, max_items=n).collect()} for n in (20, 3))
    assert whole == cut
    assert all(cut[k].confidence == 1.0 for k, b in enumerate(bad) if b) and 5 < sum(bad) < 80


def test_url_tokens_are_not_doubled(spark):
    row = spark.createDataFrame([("https://a.my-shop.com/x",)], "url string").select(
        url_tokens(F.lit("a.my-shop.com"), F.lit("/x"), F.col("url")).alias("t")).first()
    assert sorted(row.t) == sorted([
        "host:a", "host:my-shop", "host:com", "word:my", "word:shop", "path:x", "scheme:https"])


def test_url_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, 0), (2, "no scheme", 0), (3, "HTTP://WWW.Example.COM/en/?q", 0), (3, "http://x.net/fr/a", 0),
         (None, "http://x.net/fr/a", 0), (4, "", 0), (5, "https://a.net", 0)],
        "page_id long, url string, host int",
    )
    labels = spark.createDataFrame(
        [(5, 0, None), (3, None, None), (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int"
    )
    rows = judge_urls(pages, labels).collect()
    assert len(rows) == 7
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in rows}
    assert got[(1, "", "")] == (None, "allow") and got[(4, "", "")] == (None, "allow")
    assert got[(3, "www.example.com", "/en/")] == ("www.example.com/en/", "allow")
    assert got[(None, "x.net", "/fr/a")] == ("net/fr/", "block")
    assert judge_urls(pages.where("false"), labels).count() == 0
    assert judge_urls(pages, labels.where("false")).count() == 7


def test_line_above_limit(spark):
    boiler = "accept all of our cookies before you go on reading this page please, or leave it now, dear " \
             "visitor of these many pages, since we must ask"
    rows = [(k, boiler + "\n" + prose(k, 12), "h") for k in range(12)]
    rows += [(100 + k, prose(50 + k, 80) + "\n" + boiler, "h") for k in range(3)]
    rows += [(200, boiler, "other")]
    got = {r.doc_id: r for r in judge_documents(documents(spark, rows)).collect()}
    assert sum(not got[k].kept for k in range(12)) >= 11
    assert all(got[100 + k].kept for k in range(3)) and got[200].kept
    assert not any(got[k].base_failed for k in got)


def test_edited_items_are_found(spark):
    """Recall over items with edits at the limit, and no finds in clean texts."""
    import random

    rng = random.Random(3)
    items = [(k, prose(1000 + k, 20 + k % 40)) for k in range(60)]
    rows = []
    for k, text in items:
        words = split_words(text)
        for _ in range(int(0.1 * len(words))):
            at = rng.randrange(len(words))
            kind = rng.random()
            if kind < 0.34:
                words[at] = "other"
            elif kind < 0.67:
                del words[at]
            else:
                words.insert(at, "more")
        rows.append((k, prose(2000 + k, 50) + " " + " ".join(words) + " " + prose(3000 + k, 50), "s"))
    rows += [(500 + k, prose(4000 + k, 300), "s") for k in range(40)]
    bench = spark.createDataFrame(items + [(None, "null id here it is"), (99, None), (98, "too short")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents(spark, rows), bench, block_words=500).collect()}
    assert got <= {(k, k) for k, _ in items}
    assert len(got) >= 0.95 * len(items)


@pytest.mark.parametrize("kind", ["deletion", "insertion", "substitution"])
@pytest.mark.parametrize("length", [100, 200])
def test_long_edited_items_are_found(length, kind):
    """Recall over long items with edits of one kind at the limit."""
    import random

    from clickmill.llm.leaks import AGREEMENT, RECALL, SAMPLED, ItemBlock, repetitions

    rng = random.Random(length)
    vocab = [b"w%d" % k for k in range(3000)]
    items = [rng.choices(vocab, k=length) for _ in range(60)]
    texts = []
    for item in items:
        words = list(item)
        for at in sorted(rng.sample(range(length), length // 10), reverse=True):
            if kind == "deletion":
                del words[at]
            elif kind == "insertion":
                words.insert(at, b"more")
            else:
                words[at] = b"other"
        texts.append(rng.choices(vocab, k=30) + words + rng.choices(vocab, k=30))
    block = ItemBlock(list(range(60)), items, 0.1, repetitions(RECALL, SAMPLED, AGREEMENT), SAMPLED)
    found = block.find(list(range(60)), texts)
    assert {(d, i) for d, i, *_ in found} == {(k, k) for k in range(60)}
    assert all(e <= length // 10 for *_, e in found)


def test_near_duplicate_groups(spark):
    """A large group of near copies holds together and equals the brute-force components."""
    import random

    rng = random.Random(9)
    base = split_words(prose(7, 200))
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"new{k}"
        rows.append((k, " ".join(words), "s"))
    rows += [(1000 + k, prose(100 + k, 100), "s") for k in range(30)]
    got = {r.doc_id: r for r in near_duplicates(documents(spark, rows), words=3, similarity=85).collect()}
    sets = {i: {tuple(w[j:j + 3]) for j in range(len(w) - 2)} for i, t, _ in rows for w in [split_words(t)]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in sets}


def test_near_duplicates_among_a_template(spark):
    """Pairs within the limit among many documents of one template that lie just under it."""
    template = prose(5, 200)
    tails = [[f"own{k}w{j}" for j in range(21)] for k in range(600)]
    for k in range(0, 120, 2):  # planted pairs
        tails[k + 1][:8] = tails[k][:8]
    rows = [(k, template + " " + " ".join(t), "s") for k, t in enumerate(tails)]
    sets = [{tuple(w[j:j + 3]) for j in range(len(w) - 2)} for _, t, _ in rows for w in [split_words(t)]]
    linked = [
        (a, b) for a in range(600) for b in range(a + 1, 600)
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    assert linked == [(k, k + 1) for k in range(0, 120, 2)]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows), words=3, similarity=85).collect()}
    assert got == {k: k - 1 if k < 120 and k % 2 else k for k in range(600)}


def test_components_in_many_tasks(spark):
    from clickmill.llm.components import components

    chain = [(k, k + 1) for k in range(0, 400)] + [(1000 + k, 1000 + (k * 7) % 50) for k in range(50)]
    edges = spark.createDataFrame(chain, "u long, r long")
    for per_task in (10, 10_000):
        got = {r.u: r.r for r in components(edges, per_task).collect()}
        assert all(got[k] == 0 for k in range(1, 401)) and 0 not in got


def test_leak_edits_count_whole_shares():
    """0.29 x 100 is 29, though the float product is less."""
    from types import SimpleNamespace

    from clickmill.llm.leaks import ItemBlock

    assert [ItemBlock.edits(SimpleNamespace(edit_share=s), n) for s, n in ((0.29, 100), (0.1, 40), (0.1, 39), (0.1, 0))] == [29, 4, 3, 0]
