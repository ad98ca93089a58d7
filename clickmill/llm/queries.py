"""The registered queries ``opN_<name>`` and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from .alignment import align_tokenizers
from .chat import rotate_perspectives
from .divergence import audit_sources
from .encoding import TokenizerFile
from .language_id import identify_languages
from .leaks import find_leaks
from .line_quality import judge_documents
from .line_runs import drop_repeated_lines
from .lsh_forest import near_duplicates
from .mixing import score_documents
from .packing import pack_documents
from .repeats import drop_repeated_passages
from .token_cache import count_tokens
from .url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> TokenizerFile:
    """The public tokenizer of the contracts; white space gets no ids."""
    import public_tokenizers

    return TokenizerFile(public_tokenizers.path("word_bpe_49k.json"), blank_free=True)


def pair_of_tokenizers() -> tuple[TokenizerFile, TokenizerFile]:
    """The two public tokenizers that are aligned: byte-level pairs, and pieces with byte fallback."""
    import public_tokenizers

    return (
        TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"), byte_ranks=True),
        TokenizerFile(public_tokenizers.path("piece_bpe_32k.model"), library="sentencepiece"),
    )


def sha256(c: str) -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


@query("op1_chat_perspectives", oracle=r"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position,
           coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body
    FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS assistant FROM t WHERE speaker <> 'system'),
s AS (
    SELECT conv_id, assistant, position, speaker, body,
           CASE WHEN speaker = assistant THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                ELSE 'user' END AS role,
           CASE WHEN speaker = assistant THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
                ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
    FROM t JOIN p USING (conv_id)),
g AS (
    SELECT *, head || body || '<|end|>' || chr(10) AS segment,
           coalesce(sum(length(head) + length(body) + 8)
                    OVER (PARTITION BY conv_id, assistant ORDER BY position
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM s)
SELECT conv_id, assistant, position, speaker, role, segment, start,
       start + CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS mask_start,
       start + CASE WHEN role = 'assistant' THEN length(segment) ELSE 0 END AS mask_end
FROM g
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


@query("op2_line_runs", oracle=r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l),
c AS (
    SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256("kept_text").alias("kept_sha256"))


# The mined rules have no SQL form; the test holds them against brute-force item sets.
@query("op3_url_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


# Token ids are the library's; the test encodes every text with it.
@query("op4_pack_open_windows")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset",
    )


@query("op5_repeated_passages", oracle=r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
words AS (
    SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed,
           string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
    FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


@query("op6_line_quality", oracle=r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
    GROUP BY doc_id),
texts AS (SELECT host, t, any_value(l) AS l FROM d GROUP BY host, t),
lk AS (
    SELECT host, t, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
           len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT host, t, unnest(l) AS x FROM texts)),
above AS (
    SELECT host, key, min(md5(t)) AS owner FROM lk GROUP BY host, key HAVING count(DISTINCT t) >= 10),
gone AS (
    SELECT host, t, sum(n)::BIGINT AS n FROM lk JOIN above USING (host, key)
    WHERE md5(t) <> owner GROUP BY host, t),
f AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
           coalesce(gone.n, 0) AS n_removed_words
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (host, t))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND n_words - n_removed_words >= 20 AS kept
FROM f
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


# Edit distances of all windows to all items are too slow in SQL; the test searches by brute force.
@query("op7_benchmark_leaks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Token counts are the library's; the test counts every text with it.
@query("op8_digest_cache")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op9_lsh_forest", oracle=r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g
        FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id),
l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id,
       coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON node = doc_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=85)


# The trained score has no SQL form; the test holds counts and base score against brute force.
@query("op10_context_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


# Compressed sizes have no SQL form; the test repeats them in plain Python and measures accuracy.
@query("op11_zstd_languages")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


# Token ids are the libraries'; the test aligns every text by brute force.
@query("op12_merge_path_groups")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), *pair_of_tokenizers()).documents()


@query("op13_one_hot_gaps", oracle=r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
z AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (SELECT d.lang, d.source, coalesce(any_value(z.n), 0) AS n, coalesce(any_value(v.v), 0) AS v,
             coalesce(any_value(v.n), 0) AS lang_n
      FROM d LEFT JOIN z USING (lang, source) LEFT JOIN v ON v.lang = d.lang GROUP BY d.lang, d.source),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c,
           (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v))::HUGEINT AS p,
           (1 + (1000000000::HUGEINT * (k.total + 2)) // (g.lang_n + 2 * g.v))::HUGEINT AS q
    FROM g JOIN k ON k.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source),
r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
t AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part
                                 ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT * FROM t WHERE part = 'pair' OR rank <= 10
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))
