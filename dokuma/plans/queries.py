"""The registered queries of the text, token and tensor operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dokuma.functions import hashing, markup, tables, turkish
from dokuma.functions.turkish import LETTERS, LOWER, SUFFIXES, UPPER
from dokuma.operators import bpe, bpe_train, corpus, lexicon, morphology, tensor, tiles, tokens
from dokuma.operators.order import numbered, with_neighbour
from dokuma.session import forget_at_exit, shared_dir, stage, table
from dokuma.sources import tokenfiles
from dokuma.streaming import shards

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# A small lexicon and word list, as documents of the tables hold no Turkish.
LEXICON = ("kitap", "göz", "araba", "ev", "gitmek", "gidmek", "g", "okul", "ağaç", "süt", "tuz", "kapı", "yapmak", "gelmek", "okumak")

WORDS_SQL = f"SELECT translate(w, '{UPPER}', '{LOWER}') AS word FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}+')) AS w FROM {{}})"
LINES_SQL = """
lines AS (
  SELECT doc_id, pos - 1 AS pos, parts[pos] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no FROM lines)"""
STREAM_SQL = """
toks AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'sub' ELSE 'wiki' END AS corpus, pos, CAST(strlen(ws[pos]) AS INTEGER) AS token
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM documents))),
stream AS (SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY doc_id, pos) - 1 AS pos, token FROM toks)"""
E_SQL = """
e AS (SELECT vec_id AS i, label, CAST(j - 1 AS INTEGER) AS j, CAST(embedding[j] AS DOUBLE) AS v
      FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings))"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _e(spark: SparkSession, sf: str) -> DataFrame:
    return tensor.explode_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")


def _inline(spark: SparkSession, values: tuple[str, ...], name: str = "word") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.numbered_lines(_docs(spark, sf))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    return _docs(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, "sub").otherwise("wiki").alias("corpus"), "doc_id", F.transform(kept, F.octet_length).alias("tokens"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.stream(_texts(spark, sf), ["doc_id"])


@query(WORDS_SQL.format("documents").replace("SELECT translate", "SELECT word, count(*) AS cnt FROM (SELECT translate", 1) + ") GROUP BY word")
def q01_word_freq(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.word_counts(_docs(spark, sf))


@query(f"SELECT word, count(*) AS cnt FROM ({WORDS_SQL.format('documents')}) GROUP BY word ORDER BY cnt DESC, word LIMIT 1000")
def q02_word_freq_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.top_words(corpus.word_counts(_docs(spark, sf)), 1000)


@query("SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) WHERE strlen(word) BETWEEN 1 AND 63 AND NOT contains(word, ':')")
def q03_lexicon_candidates(spark: SparkSession, sf: str) -> DataFrame:
    words = _docs(spark, sf).select(F.explode(F.split("text", "[ \n]+")).alias("word"))
    return words.where(F.octet_length("word").between(1, 63) & ~F.col("word").contains(":")).distinct()


@query(
    f"WITH w AS ({WORDS_SQL.format('documents')} UNION ALL SELECT unnest({list(LEXICON)}) AS word) "
    "SELECT word FROM w UNION SELECT substring(word, 1, length(word) - 3) FROM w WHERE regexp_matches(word, 'm[ae]k$') AND strlen(word) >= 4"
)
def q04_bare_verb_roots(spark: SparkSession, sf: str) -> DataFrame:
    words = corpus.word_counts(_docs(spark, sf)).select("word").unionByName(_inline(spark, LEXICON))
    return morphology.lexicon(words)


_SIDES = f"WITH a AS (SELECT DISTINCT word FROM ({WORDS_SQL.format('documents')})), b AS (SELECT DISTINCT word FROM ({WORDS_SQL.format('benchmark')})) "


@query(_SIDES + "SELECT word FROM b WHERE word IN (SELECT word FROM a)")
def q05_lexicon_semi(spark: SparkSession, sf: str) -> DataFrame:
    known = corpus.word_counts(_docs(spark, sf)).select("word")
    return corpus.word_counts(table(spark, sf, "benchmark")).select("word").join(known, "word", "left_semi")


@query(_SIDES + "SELECT word FROM a WHERE word NOT IN (SELECT word FROM b)")
def q05_lexicon_anti(spark: SparkSession, sf: str) -> DataFrame:
    known = corpus.word_counts(table(spark, sf, "benchmark")).select("word")
    return corpus.word_counts(_docs(spark, sf)).select("word").join(known, "word", "left_anti")


@query(
    f"WITH f AS (SELECT word, count(*) AS cnt FROM ({WORDS_SQL.format('documents')}) GROUP BY word) "
    f"SELECT b.word, coalesce(f.cnt, 0) AS cnt FROM (SELECT DISTINCT word FROM ({WORDS_SQL.format('benchmark')})) b LEFT JOIN f ON f.word = b.word"
)
def q06_freq_lookup_default0(spark: SparkSession, sf: str) -> DataFrame:
    counts = corpus.word_counts(_docs(spark, sf))
    words = corpus.word_counts(table(spark, sf, "benchmark")).select("word")
    return words.join(counts, "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"))


_OTHER = "[^" + LETTERS[1:]


@query(
    f"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{LETTERS}+|{_OTHER}+')) AS run FROM documents) "
    f"SELECT doc_id, count(*) AS n_runs, count(*) FILTER (WHERE regexp_matches(run, '^{LETTERS}')) AS n_letter_runs, max(strlen(run)) AS longest FROM r GROUP BY doc_id"
)
def q07_letter_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.explode(tokens.runs(F.col("text"))).alias("run"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("run").rlike(f"^{LETTERS}")).alias("n_letter_runs"), F.max(F.octet_length("run").cast("long")).alias("longest"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\n{2,}')) AS BIGINT) AS n_eos FROM documents")
def q08_eos_count(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", tokens.eos_count(F.col("text")).cast("long").alias("n_eos"))


@query(
    "SELECT 'documents' AS t, count(*) FILTER (WHERE strlen(text) > 200 AND strlen(text) < 8388608) AS n_articles, count(*) FILTER (WHERE strlen(text) >= 24) AS n_long, count(*) AS n FROM documents "
    "UNION ALL SELECT 'pages', count(*) FILTER (WHERE strlen(html) > 200 AND strlen(html) < 8388608), count(*) FILTER (WHERE strlen(html) >= 24), count(*) FROM pages"
)
def q09_byte_length_gates(spark: SparkSession, sf: str) -> DataFrame:
    both = _docs(spark, sf).select(F.lit("documents").alias("t"), F.octet_length("text").alias("n")).unionByName(table(spark, sf, "pages").select(F.lit("pages").alias("t"), F.octet_length("html").alias("n")))
    return both.groupBy("t").agg(F.count_if((F.col("n") > corpus.ARTICLE) & (F.col("n") < corpus.RAW)).alias("n_articles"), F.count_if(F.col("n") >= corpus.LONG).alias("n_long"), F.count("*").alias("n"))


_MARKS = " OR ".join(f"contains(text, '{m}')" for m in markup.CREDITS)


@query(
    f"WITH {LINES_SQL} SELECT doc_id, pos, ({_MARKS}) AS credit, "
    "regexp_matches(regexp_replace(text, '<[^<>]*>|[{\\[][^{}\\[\\]]*[}\\]]', '', 'g'), '[♪♫]') AS song, "
    f"regexp_matches(text, '{LETTERS}') AS has_letter FROM lines"
)
def q10_credit_song_filters(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return corpus.lines(_docs(spark, sf)).select("doc_id", F.col("pos").cast("long").alias("pos"), markup.credit_line(text).alias("credit"), markup.song_line(text).alias("song"), turkish.has_letter(text).alias("has_letter"))


@query(
    f"WITH {LINES_SQL}, l AS (SELECT *, lag(text) OVER (ORDER BY doc_id, pos) AS before FROM lines WHERE text <> '') "
    "SELECT doc_id, pos, text FROM l WHERE before IS NULL OR before <> text"
)
def q11_consecutive_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.lines(_docs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))
    return corpus.consecutive_distinct(rows, ["doc_id", "pos"])


@query(
    f"WITH {LINES_SQL} SELECT line_no // 200 AS block_id, count(*) AS n_lines, count(*) FILTER (WHERE strlen(text) >= 24) AS n_long, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM numbered GROUP BY 1"
)
def q12_block_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.block_stats(_lines(spark, sf))


@query(
    f"WITH {LINES_SQL}, l AS (SELECT line_no // 200 AS block_id, text FROM numbered WHERE strlen(text) >= 24), "
    "f AS (SELECT text, min(block_id) AS first FROM l GROUP BY text) "
    "SELECT block_id, count(*) AS n_long, count(*) FILTER (WHERE first < block_id) AS n_dup, 2 * count(*) FILTER (WHERE first < block_id) > count(*) AS duplicate FROM l JOIN f USING (text) GROUP BY block_id"
)
def q13_block_dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    long = stage(corpus.long_lines(_lines(spark, sf)), "long")
    return corpus.majority(long, long).withColumn("duplicate", F.col("n_dup") * 2 > F.col("n_long"))


_BLOCKS_SQL = f"""
WITH RECURSIVE {LINES_SQL},
l AS (SELECT line_no, line_no // 200 AS block_id, text FROM numbered WHERE strlen(text) >= 24),
has AS (SELECT DISTINCT text, block_id FROM l),
earlier AS (SELECT l.line_no, l.block_id, list(has.block_id) FILTER (WHERE has.block_id < l.block_id) AS seen FROM l JOIN has USING (text) GROUP BY 1, 2),
b AS (SELECT block_id, row_number() OVER (ORDER BY block_id) AS k, list(coalesce(seen, [])) AS seen, count(*) AS n_long FROM earlier GROUP BY block_id),
r AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS block_id, CAST(0 AS BIGINT) AS n_long, CAST(0 AS BIGINT) AS n_dup, CAST([] AS BIGINT[]) AS kept_blocks
  UNION ALL
  SELECT k, block_id, n_long, n_dup, CASE WHEN 2 * n_dup <= n_long THEN list_append(kept_blocks, block_id) ELSE kept_blocks END
  FROM (SELECT b.k, b.block_id, b.n_long, CAST(len(list_filter(b.seen, lambda s: list_has_any(s, r.kept_blocks))) AS BIGINT) AS n_dup, r.kept_blocks FROM r JOIN b ON b.k = r.k + 1))
SELECT block_id, n_long, n_dup, 2 * n_dup <= n_long AS kept FROM r WHERE k > 0"""


@query(_BLOCKS_SQL)
def q14_block_dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.dedup_blocks(corpus.long_lines(_lines(spark, sf)))


@query()
def q15_block_sample(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sample_blocks(q14_block_dedup_exact(spark, sf).where("kept"))


@query(f"WITH {STREAM_SQL} SELECT corpus, count(*) AS num_tokens, count(*) - count(*) * 10 // 1000 AS train_tokens, count(*) * 10 // 1000 AS val_tokens FROM stream GROUP BY corpus")
def q16_train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.split(_texts(spark, sf).where(F.size("tokens") > 0), F.size("tokens").cast("long"))


@query(
    f"WITH {STREAM_SQL}, s AS (SELECT corpus, count(*) AS n, count(*) * 10 // 1000 AS val FROM stream GROUP BY corpus), "
    "w AS (SELECT corpus, k AS window, n - val + k * ((val - 32 - 1) // 8) AS start FROM s, range(8) r(k) WHERE val >= 8 + 32 + 1) "
    "SELECT w.corpus, CAST(w.window AS INTEGER) AS window, w.start, CAST(sum(token) FILTER (WHERE pos < start + 32) AS BIGINT) AS ids_sum, CAST(sum(token) FILTER (WHERE pos > start) AS BIGINT) AS targets_sum "
    "FROM w JOIN stream t ON t.corpus = w.corpus AND t.pos BETWEEN w.start AND w.start + 32 GROUP BY 1, 2, 3"
)
def q17_val_windows(spark: SparkSession, sf: str) -> DataFrame:
    toks = stage(_stream(spark, sf), "stream")
    windows = tokens.validation_windows(tokens.split(toks), 8, 32)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return tokens.window_tokens(windows, toks, 32).select("corpus", "window", "start", total("ids").alias("ids_sum"), total("targets").alias("targets_sum"))


@query(
    f"WITH {STREAM_SQL}, p AS (SELECT corpus, token, lead(token) OVER (PARTITION BY corpus ORDER BY pos) AS next FROM stream) "
    "SELECT corpus, token, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2, 3"
)
def q18_next_token_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.next_tokens(_texts(spark, sf), ["doc_id"]).groupBy("corpus", "token", "next").agg(F.count("*").alias("n"))


@query()
def q19_mixture_batch(spark: SparkSession, sf: str) -> DataFrame:
    toks = stage(_stream(spark, sf), "stream")
    return tokens.window_tokens(tokens.mixture(tokens.split(toks), 1, 128), toks, 128)


@query(
    "WITH s AS (SELECT lang, source, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, "
    "CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens FROM documents GROUP BY 1, 2) "
    "SELECT *, n_bytes // greatest(n_tokens, 1) AS bytes_per_token FROM s"
)
def q20_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_stats(_docs(spark, sf), "lang", "source")


_STRIP = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _name in ("lt", "gt", "quot", "apos", "nbsp", "amp"):
    _STRIP = f"replace({_STRIP}, '&{_name};', '{markup.ENTITIES[_name].replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, {_STRIP} AS text FROM pages")
def q21_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", markup.strip_tags(F.col("html")).alias("text"))


@query()
def q21_wikitext_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", markup.wikitext_col(markup.unescape_col("html")).alias("text"))


@query()
def q21_subtitle_clean(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.lines(_docs(spark, sf)).select("doc_id", "pos", markup.subtitle_col("text").alias("text")).where("text <> ''")


_SYMS_SQL = f"""
w AS (SELECT word, count(*) AS cnt FROM ({WORDS_SQL.format('documents')}) GROUP BY word),
s AS (SELECT word, cnt, pos, CAST(('0x' || substring(hex(encode(word)), CAST(2 * pos + 1 AS INTEGER), 2)) AS INTEGER) AS sym
      FROM (SELECT word, cnt, unnest(range(0, strlen(word))) AS pos FROM w)),
p AS (SELECT sym AS "left", lead(sym) OVER (PARTITION BY word ORDER BY pos) AS "right", cnt FROM s),
pairs AS (SELECT "left", "right", CAST(sum(cnt) AS BIGINT) AS weight FROM p WHERE "right" IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {_SYMS_SQL} SELECT * FROM pairs")
def q22_bpe_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.pairs(bpe.symbols(corpus.word_counts(_docs(spark, sf))))


@query(f'WITH {_SYMS_SQL} SELECT "left", "right", weight FROM pairs ORDER BY weight DESC, "left", "right" LIMIT 1')
def q23_bpe_best_pair(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.best_pair(q22_bpe_pair_counts(spark, sf))


@query(
    f'WITH {_SYMS_SQL}, b AS (SELECT * FROM pairs WHERE "left" <> "right" ORDER BY weight DESC, "left", "right" LIMIT 1), '
    'm AS (SELECT word, cnt, pos, sym, sym = b."left" AND lead(sym) OVER (PARTITION BY word ORDER BY pos) = b."right" AS hit FROM s, b), '
    "g AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM m) "
    "SELECT word, count(*) AS n_symbols, count(*) FILTER (WHERE hit) AS n_merged FROM g WHERE NOT gone GROUP BY word"
)
def q23_bpe_apply_merge(spark: SparkSession, sf: str) -> DataFrame:
    syms = bpe.symbols(corpus.word_counts(_docs(spark, sf)))
    pair = bpe.best_pair(bpe.pairs(syms).where("left <> right")).first()
    if pair is None:
        return syms.groupBy("word").agg(F.count("*").alias("n_symbols"), F.lit(0).cast("long").alias("n_merged"))
    merged = bpe.apply_merge(syms, pair["left"], pair["right"], 256)
    return merged.groupBy("word").agg(F.count("*").alias("n_symbols"), F.count_if(F.col("sym") == 256).alias("n_merged"))


def _merges(spark: SparkSession, sf: str) -> bpe.Merges:
    """The merges of a data folder's words, trained anew by each query that needs them."""
    return bpe.Merges(bpe.train(corpus.word_counts(_docs(spark, sf)), 200))


@query()
def q24_bpe_train(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(_merges(spark, sf).merges)], "rank int, left int, right int, new_id int")


@query()
def q25_bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_words(corpus.word_counts(_docs(spark, sf)), _merges(spark, sf))


@query(f"SELECT DISTINCT word, word AS decoded, true AS same FROM ({WORDS_SQL.format('documents')})")
def q26_decode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    merges = _merges(spark, sf)
    rows = bpe.decode_words(bpe.encode_words(corpus.word_counts(_docs(spark, sf)), merges), merges)
    return rows.select("word", "decoded", (F.col("word") == F.col("decoded")).alias("same"))


_SUFFIX_VALUES = ", ".join(f"({i}, '{x.template}', '{x.buffer}', {x.softening}, {x.drop_vowel}, '{x.kind}', {x.slot})" for i, x in enumerate(SUFFIXES))
_SUFFIX_SQL = f"t(suffix_id, template, buffer, softening, drop_vowel, kind, slot) AS (VALUES {_SUFFIX_VALUES})"


def _inflected_sql(source: str, columns: str) -> str:
    """`columns`, and word: what a stem and a suffix of `source` make together."""
    return f"""(SELECT {columns}, root || replace(replace(replace(replace(body,
  'A', CASE WHEN v IN ('e','i','ö','ü') THEN 'e' ELSE 'a' END),
  'I', CASE WHEN v IN ('a','ı') THEN 'ı' WHEN v IN ('o','u') THEN 'u' WHEN v IN ('ö','ü') THEN 'ü' ELSE 'i' END),
  'D', CASE WHEN hard THEN 't' ELSE 'd' END), 'C', CASE WHEN hard THEN 'ç' ELSE 'c' END) AS made
 FROM (SELECT *, CASE WHEN opens AND l IN ('a','e','ı','i','o','ö','u','ü') THEN CASE WHEN drop_vowel THEN substring(template, 2) ELSE buffer || template END ELSE template END AS body,
   CASE WHEN opens AND softening AND l IN ('p','ç','t','k') THEN left(stem, length(stem) - 1) || translate(l, 'pçtk', 'bcdğ') ELSE stem END AS root,
   l IN ('f','s','t','k','ç','ş','h','p') AS hard
  FROM (SELECT *, right(stem, 1) AS l, coalesce(right(regexp_replace(stem, '[^aeıioöuü]', '', 'g'), 1), '') AS v, left(template, 1) IN ('A', 'I') AS opens FROM {source})))"""


@query(f"""
WITH {_SUFFIX_SQL}, s AS (SELECT DISTINCT word AS stem FROM ({WORDS_SQL.format('documents')}))
SELECT stem, CAST(suffix_id AS INTEGER) AS suffix_id, made AS word FROM {_inflected_sql('(SELECT * FROM s, t)', 'stem, suffix_id')}""")
def q27_suffix_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents with every suffix of the fixed table."""
    table_ = F.array(*(F.struct(F.lit(i).alias("suffix_id"), *(F.lit(getattr(x, c)).alias(c) for c in ("template", "buffer", "softening", "drop_vowel"))) for i, x in enumerate(SUFFIXES)))
    rows = corpus.word_counts(_docs(spark, sf)).select(F.col("word").alias("stem"), F.inline(table_))
    return rows.select("stem", "suffix_id", turkish.resolve_col(*(F.col(c) for c in ("stem", "template", "buffer", "softening", "drop_vowel"))).alias("word"))


@query(f"""
WITH RECURSIVE {_SUFFIX_SQL},
counts AS (SELECT word, count(*) AS cnt FROM ({WORDS_SQL.format('documents')}) GROUP BY word),
seed AS (SELECT word FROM counts WHERE cnt >= 50 UNION SELECT unnest({list(LEXICON)})),
known AS (SELECT word FROM seed UNION SELECT substring(word, 1, length(word) - 3) FROM seed WHERE regexp_matches(word, 'm[ae]k$') AND strlen(word) >= 4),
r AS (
  SELECT word, word AS form, '' AS path, '' AS suffixes, '' AS kind, 4 AS slot, 0 AS depth FROM counts WHERE strlen(word) < 64
  UNION ALL
  SELECT word, form, path, suffixes, kind, slot, depth FROM (
    SELECT word, unnest(CASE WHEN softening AND right(stem, 1) IN ('b','c','d','ğ') THEN [stem, left(stem, length(stem) - 1) || translate(right(stem, 1), 'bcdğ', 'pçtk')] ELSE [stem] END) AS form,
      path || printf('%02d%02d', suffix_id, 99 - length(stem)) || unnest(CASE WHEN softening AND right(stem, 1) IN ('b','c','d','ğ') THEN ['0', '1'] ELSE ['0'] END) AS path,
      CASE WHEN suffixes = '' THEN CAST(suffix_id AS VARCHAR) ELSE suffix_id || ',' || suffixes END AS suffixes, kind, slot, depth
    FROM {_inflected_sql("""(SELECT r.word, r.form, r.path, r.suffixes, r.depth + 1 AS depth, substring(r.form, 1, CAST(n AS INTEGER)) AS stem, t.suffix_id, t.template, t.buffer, t.softening, t.drop_vowel,
        CASE WHEN t.kind = 'derivational' THEN r.kind ELSE t.kind END AS kind, CASE WHEN t.slot > 0 THEN t.slot ELSE r.slot END AS slot
      FROM r, t, range(1, 64) x(n)
      WHERE r.depth < 6 AND strlen(r.form) >= 2 AND n < length(r.form) AND n >= length(r.form) - 5 AND (t.kind = 'derivational' OR r.kind IN ('', t.kind)) AND (t.slot = 0 OR t.slot < r.slot))""", 'word, form, path, suffixes, depth, stem, suffix_id, softening, kind, slot')}
    WHERE made = form)),
p AS (SELECT r.word, form AS root, suffixes, depth, row_number() OVER (PARTITION BY r.word ORDER BY path) - 1 AS parse_no FROM r JOIN known k ON k.word = r.form),
b AS (SELECT p.*, coalesce(c.cnt, 0) AS cnt, row_number() OVER (PARTITION BY p.word ORDER BY coalesce(c.cnt, 0) DESC, depth, parse_no) AS place FROM p LEFT JOIN counts c ON c.word = p.root WHERE parse_no < 16)
SELECT word, CAST(parse_no AS INTEGER) AS parse_no, root, suffixes, cnt FROM b WHERE place = 1""")
def q28_analyze_disambiguate(spark: SparkSession, sf: str) -> DataFrame:
    """The words of the documents against their frequent words and a few Turkish roots as the lexicon."""
    counts = stage(corpus.word_counts(_docs(spark, sf)), "counts")
    known = morphology.lexicon(counts.where("cnt >= 50").select("word").unionByName(_inline(spark, LEXICON)))
    best = morphology.disambiguate(lexicon.analyze_words(counts, known), counts)
    return best.select("word", "parse_no", "root", F.concat_ws(",", F.transform("suffixes", lambda x: x.cast("string"))).alias("suffixes"), "cnt")


@query()
def q29_tokenize_corpus(spark: SparkSession, sf: str) -> DataFrame:
    known = frozenset(r[0] for r in morphology.lexicon(_inline(spark, LEXICON)).collect())
    return tokens.tokenize(_docs(spark, sf), tokens.Vocabulary(_merges(spark, sf)), known, {"git": 1000, "gid": 1})


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.withColumn("v", F.round("v", places) + 0.0)


R = "round({}, 4) + 0.0"


@query(f"WITH {E_SQL} SELECT a.label, a.j AS i, b.j, {R.format('sum(a.v * b.v)')} AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2, 3")
def q30_gram_by_label(spark: SparkSession, sf: str) -> DataFrame:
    products = tiles.entries(tiles.gram(table(spark, sf, "embeddings"), "embedding", ("label",)), ("label",))
    return _rounded(products.select("label", F.col("i").cast("int").alias("i"), "j", "v"))


@query(f"WITH {E_SQL} SELECT i, j, {R.format('v + v * v')} AS added, {R.format('v * 3')} AS scaled, {R.format('greatest(v, 0)')} AS relu, {R.format('1 / (1 + exp(-v))')} AS sigmoid, {R.format('(exp(2 * v) - 1) / (exp(2 * v) + 1)')} AS tanh FROM e")
def q31_elementwise(spark: SparkSession, sf: str) -> DataFrame:
    v, r = F.col("v"), lambda c: F.round(c, 4) + 0.0
    return _e(spark, sf).select("i", "j", r(v + v * v).alias("added"), r(v * 3).alias("scaled"), r(tensor.relu(v)).alias("relu"), r(tensor.sigmoid(v)).alias("sigmoid"), r(F.tanh(v)).alias("tanh"))


@query(f"WITH {E_SQL} SELECT CAST(j AS BIGINT) AS i, i AS j, {R.format('v')} AS v FROM e WHERE j < 8 UNION ALL SELECT CAST(j - 8 + 1000 AS BIGINT), i, {R.format('v')} FROM e WHERE j >= 8 AND j < 16")
def q32_transpose_slice_concat(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf)
    left, right = (tensor.transpose(tensor.slice_cols(e, lo, lo + 8)) for lo in (0, 8))
    return _rounded(tensor.concat_rows(left, right, 1000).select(F.col("i").cast("long").alias("i"), "j", "v"))


@query(f"WITH {E_SQL}, x AS (SELECT i, j, exp(v - max(v) OVER (PARTITION BY i)) AS x FROM e) SELECT i, j, {R.format('x / sum(x) OVER (PARTITION BY i)')} AS v FROM x")
def q33_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tensor.softmax(_e(spark, sf)))


@query(f"WITH {E_SQL} SELECT i, j, {R.format('v / sqrt(avg(v * v) OVER (PARTITION BY i) + 1e-5)')} AS v FROM e")
def q34_rmsnorm(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tensor.rmsnorm(_e(spark, sf)))


@query(
    f"WITH {E_SQL}, p AS (SELECT i % 16 AS pos, i, j // 2 AS k, max(v) FILTER (WHERE j % 2 = 0) AS x, max(v) FILTER (WHERE j % 2 = 1) AS y FROM e GROUP BY 1, 2, 3), "
    "a AS (SELECT *, pos * pow(10000.0, -2 * k / 64.0) AS t FROM p) "
    f"SELECT i, CAST(2 * k AS INTEGER) AS j, {R.format('x * cos(t) - y * sin(t)')} AS v FROM a UNION ALL SELECT i, CAST(2 * k + 1 AS INTEGER), {R.format('x * sin(t) + y * cos(t)')} FROM a"
)
def q35_rope(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tensor.rope(_e(spark, sf), 64, position=F.col("i") % 16))


@query(
    f"WITH {E_SQL}, x AS (SELECT i // 16 AS b, i % 16 AS i, j, v FROM e), "
    "s AS (SELECT q.b, q.i, k.i AS j, sum(q.v * k.v) / 8 AS z FROM x q JOIN x k ON q.b = k.b AND q.j = k.j AND k.i <= q.i GROUP BY 1, 2, 3), "
    "p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY b, i)) AS x FROM s), w AS (SELECT b, i, j, x / sum(x) OVER (PARTITION BY b, i) AS p FROM p) "
    f"SELECT w.b, w.i, v.j, {R.format('sum(w.p * v.v)')} AS v FROM w JOIN x v ON v.b = w.b AND v.i = w.j GROUP BY 1, 2, 3"
)
def q36_causal_attention(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding")
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("b"), (F.col("vec_id") % 16).alias("i"), x.alias("q"), x.alias("k"), x.alias("v"))
    return _rounded(tiles.attention(rows, 64, ("b",)).select("b", "i", F.posexplode("v").alias("j", "v")))


@query(
    f"WITH {E_SQL}, h AS (SELECT i, j % 32 AS j, max(v) FILTER (WHERE j < 32) AS g, max(v) FILTER (WHERE j >= 32) AS u FROM e GROUP BY 1, 2) "
    f"SELECT h.i, CAST(d.o AS INTEGER) AS j, {R.format('sum(g / (1 + exp(-g)) * u * ((h.j + d.o) % 3 - 1))')} AS v FROM h, range(4) d(o) GROUP BY 1, 2"
)
def q37_swiglu(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf)
    down = spark.range(32 * 4).select(F.floor(F.col("id") / 4).cast("int").alias("i"), (F.col("id") % 4).cast("int").alias("j")).withColumn("v", ((F.col("i") + F.col("j")) % 3 - 1).cast("double"))
    return _rounded(tensor.swiglu(tensor.slice_cols(e, 0, 32), tensor.slice_cols(e, 32, 64), down))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("target"))


_LOSS = f"WITH {E_SQL}, m AS (SELECT *, max(v) OVER (PARTITION BY i) AS m FROM e), l AS (SELECT i, ln(sum(exp(v - m))) + max(m) - max(v) FILTER (WHERE j = label) AS loss FROM m GROUP BY i HAVING count(*) FILTER (WHERE j = label) > 0) "


@query(_LOSS + f"SELECT {R.format('avg(loss)')} AS loss, {R.format('exp(avg(loss))')} AS perplexity, count(*) AS n FROM l")
def q38_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    loss = tensor.cross_entropy(_e(spark, sf), _targets(spark, sf))
    return loss.agg((F.round(F.avg("loss"), 4) + 0.0).alias("loss"), (F.round(F.exp(F.avg("loss")), 4) + 0.0).alias("perplexity"), F.count("*").alias("n"))


@query(f"WITH {E_SQL}, x AS (SELECT *, exp(v - max(v) OVER (PARTITION BY i)) AS x FROM e) SELECT i, j, {R.format('x / sum(x) OVER (PARTITION BY i) - CASE WHEN j = label THEN 1 ELSE 0 END')} AS v FROM x")
def q39_ce_grad(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tensor.cross_entropy_grad(_e(spark, sf), _targets(spark, sf), 1))


@query(f"WITH {E_SQL}, t AS (SELECT label, j, avg(v) AS v FROM e GROUP BY 1, 2) SELECT x.vec_id AS i, t.j, {R.format('t.v')} AS v FROM embeddings x JOIN t ON t.label = x.label")
def q40_embed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = _targets(spark, sf).withColumnRenamed("target", "token")
    weights = _e(spark, sf).join(ids, "i").groupBy(F.col("token").alias("i"), "j").agg(F.avg("v").alias("v"))
    return _rounded(tensor.embed(ids, weights))


@query(f"WITH {E_SQL} SELECT label AS i, j, {R.format('sum(v)')} AS v FROM e GROUP BY 1, 2")
def q41_embed_grad(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tensor.embed_grad(_targets(spark, sf).withColumnRenamed("target", "token"), _e(spark, sf)))


@query(f"WITH {E_SQL} SELECT {R.format('sqrt(sum(v * v))')} AS norm, {R.format('least(1, 1 / sqrt(sum(v * v)))')} AS scale FROM e")
def q42_grad_norm_clip(spark: SparkSession, sf: str) -> DataFrame:
    out = tensor.clip_scale(_e(spark, sf))
    return out.select(*[(F.round(c, 4) + 0.0).alias(c) for c in ("norm", "scale")])


@query(
    f"WITH {E_SQL}, s AS (SELECT i, j, v, 0.9 * v * 0.1 + 0.1 * v * 0.5 AS m, 0.999 * v * v + 0.001 * v * 0.5 * v * 0.5 AS s FROM e) "
    f"SELECT i, j, {R.format('v - 0.01 * (m / (1 - pow(0.9, 3))) / (sqrt(s / (1 - pow(0.999, 3))) + 1e-8)')} AS v, {R.format('m')} AS m, {R.format('s')} AS s FROM s"
)
def q43_adam_step(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    out = tensor.adam(_e(spark, sf).withColumns({"grad": v * 0.5, "m": v * 0.1, "s": v * v}), 3, 0.01)
    return out.select("i", "j", *[(F.round(c, 4) + 0.0).alias(c) for c in ("v", "m", "s")])


@query("SELECT event_id, round(CASE WHEN s < 20 THEN 0.5 * (s + 1) / 20.0 ELSE 0.05 + (0.5 - 0.05) * 0.5 * (1 + cos(pi() * least(1.0, (s - 20) / 80.0))) END, 6) AS lr FROM (SELECT event_id, event_id % 150 AS s FROM events)")
def q44_lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The rate of a step for each event, as if each 150 events were a run of steps."""
    step = F.col("event_id") % 150
    return table(spark, sf, "events").select("event_id", F.round(tensor.warmup_cosine(step, 20, 100, 0.5, 0.05), 6).alias("lr"))


@query(
    "WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events WHERE value IS NOT NULL), "
    "c AS (SELECT user_id, list(value ORDER BY n) AS vs FROM n GROUP BY user_id) "
    "SELECT n.user_id, n.event_id, round(list_reduce(c.vs[1:n.n + 1], lambda a, x: 0.98 * a + 0.02 * x), 4) + 0.0 AS ema, "
    "coalesce(n.value < min(n.value) OVER (PARTITION BY n.user_id ORDER BY n.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM n JOIN c USING (user_id)"
)
def q45_ema_best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value is not null").select("user_id", "event_id", "value")
    out = tensor.best_so_far(tensor.ema(rows, "event_id", "value", by=("user_id",)), "event_id", "value", ("user_id",))
    return out.select("user_id", "event_id", (F.round("ema", 4) + 0.0).alias("ema"), "is_best")


@query(f"WITH {E_SQL} SELECT CAST(l AS INTEGER) AS layer, CAST(i % 12 AS INTEGER) AS source, i, j, v FROM e JOIN range(24) r(l) ON l % 12 = i % 12")
def q46_depth_growth(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors as parameters of 12 layers, taken over by 24."""
    layer = (F.col("i") % 12).cast("int")
    return tensor.grow_depth(_e(spark, sf).withColumns({"layer": layer, "source": layer}), 12, 24).select("layer", "source", "i", "j", "v")


@query(
    "WITH r AS (SELECT o_custkey, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY 1, 2), "
    "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY revenue DESC, o_custkey) AS INTEGER) AS place FROM r) SELECT * FROM k WHERE place <= 10"
)
def q47_relational(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_quantity > 10")
    joined = table(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = joined.groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
    best = Window.partitionBy("o_orderpriority").orderBy(F.desc("revenue"), "o_custkey")
    return revenue.withColumn("place", F.row_number().over(best)).where("place <= 10")


@query()
def q48_subtitle_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.subtitle_corpus(_docs(spark, sf))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def q49_turn_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return rows.withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))


@query(
    f"WITH {LINES_SQL}, h AS (SELECT doc_id, pos, list_reduce(list_prepend(CAST({hashing.OFFSET} AS HUGEINT), list_transform(range(strlen(text)), "
    "lambda i: CAST(('0x' || substring(hex(encode(text)), CAST(2 * i + 1 AS INTEGER), 2)) AS HUGEINT))), "
    f"lambda a, x: xor(a, x) * {hashing.PRIME} % 18446744073709551616) AS h FROM lines) "
    "SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM h"
)
def q50_fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.lines(_docs(spark, sf)).select("doc_id", "pos", hashing.fnv1a_col("text").alias("hash"))


@query(
    f"WITH {E_SQL}, x AS (SELECT i, j, exp(v - max(v) OVER (PARTITION BY i)) AS x FROM e), p AS (SELECT i, j, x / sum(x) OVER (PARTITION BY i) AS p FROM x), "
    "c AS (SELECT i, j, sum(p) OVER (PARTITION BY i ORDER BY j) AS c FROM p) SELECT i, min(j) AS j FROM c WHERE c >= (i % 97) / 97.5 GROUP BY i"
)
def q51_sample_next(spark: SparkSession, sf: str) -> DataFrame:
    p = tensor.softmax(_e(spark, sf)).withColumnRenamed("v", "p")
    return tokens.sample_next(p, F.col("i") % 97 / F.lit(97.5))


@query(
    f"WITH {E_SQL}, x AS (SELECT *, 1 / sqrt(avg(v * v) OVER (PARTITION BY i) + 1e-5) AS r, sum(v * v * (j % 5)) OVER (PARTITION BY i) AS s, count(*) OVER (PARTITION BY i) AS n FROM e) "
    f"SELECT i, j, {R.format('(j % 5) * r * v - pow(r, 3) / n * v * s')} AS v FROM x"
)
def q52_rmsnorm_grad(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf)
    weight = spark.range(64).select(F.col("id").cast("int").alias("j"), (F.col("id") % 5).cast("double").alias("w"))
    return _rounded(tensor.rmsnorm_grad(e, weight, e)[0])


@query(f"WITH {E_SQL}, y AS (SELECT i, j, v, exp(v) / sum(exp(v)) OVER (PARTITION BY i) AS y FROM e) SELECT i, j, {R.format('y * (v - sum(y * v) OVER (PARTITION BY i))')} AS v FROM y")
def q53_softmax_grad(spark: SparkSession, sf: str) -> DataFrame:
    e = _e(spark, sf)
    return _rounded(tensor.softmax_grad(tensor.softmax(e), e))


@query(f"WITH {LINES_SQL} SELECT doc_id, pos, line_no FROM numbered")
def q54_line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.lines(_docs(spark, sf)).select("doc_id", F.col("pos").cast("long").alias("pos"))
    return numbered(rows, ["doc_id", "pos"], "line_no")


@query(f"WITH {LINES_SQL} SELECT doc_id, pos, lead(strlen(text)) OVER (ORDER BY doc_id, pos) AS next_bytes FROM lines")
def q55_next_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.lines(_docs(spark, sf)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.octet_length("text").cast("long").alias("bytes"))
    return with_neighbour(rows, ["doc_id", "pos"], "bytes", "next_bytes", ahead=True).select("doc_id", "pos", "next_bytes")


@query(f"SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, runs[pos] AS token, regexp_matches(runs[pos], '^{LETTERS}') AS letters FROM (SELECT doc_id, runs, unnest(range(1, len(runs) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{LETTERS}+|{_OTHER}+') AS runs FROM documents))")
def q56_document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    name = tables.register_document_tokens(spark)
    return spark.sql(f"SELECT d.doc_id, t.pos, t.token, t.letters FROM {{documents}} d, LATERAL {name}(d.text, kind => 'runs') t", documents=_docs(spark, sf))


@query(f"WITH {STREAM_SQL} SELECT corpus, pos // 10000 AS part, count(*) AS n, CAST(sum(token) AS BIGINT) AS total, CAST(sum(token * (pos % 1000)) AS BIGINT) AS weighted FROM stream GROUP BY 1, 2")
def q57_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """The token streams written to files by the tasks that hold them, and read again by byte ranges."""
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(tokens.placed(_texts(spark, sf), ["doc_id"]), path, per_file=1 << 20)
    forget_at_exit(spark, path)
    rows = tokenfiles.read_tokens(spark, path, split_bytes=1 << 20)
    weighted = F.sum(F.col("token") * (F.col("pos") % 1000))
    return rows.groupBy("corpus", F.floor(F.col("pos") / 10000).alias("part")).agg(F.count("*").alias("n"), F.sum("token").alias("total"), weighted.alias("weighted"))


@query(f"SELECT block_id, n_long FROM ({_BLOCKS_SQL}) WHERE kept")
def q58_stream_block_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of lines arrive in three shards, one after the other; those that the stream keeps."""
    long = stage(corpus.long_lines(_lines(spark, sf)), "long")
    home = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    forget_at_exit(spark, home)
    last = long.agg(F.max("block_id")).first()[0] or 0
    shard = F.least(F.floor(F.col("block_id") * 3 / (last + 1)), F.lit(2))
    query = None
    for n in range(3):
        long.where(shard == n).write.mode("append").parquet(f"{home}/in")
        if query is None:
            arriving = spark.readStream.schema(long.schema).parquet(f"{home}/in")
            query = shards.dedup_shards(arriving, f"{home}/seen", f"{home}/out", f"{home}/checkpoint")
        query.processAllAvailable()
    query.stop()
    return spark.read.schema("block_id bigint, text string, part int").parquet(f"{home}/out").groupBy("block_id").agg(F.count("*").alias("n_long"))


@query(
    "WITH n AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE value IS NOT NULL) "
    "SELECT event_id, round(a.e, 4) + 0.0 AS ema, coalesce(value < least_before, true) AS is_best "
    "FROM (SELECT event_id, n, value, min(value) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_before FROM n) "
    "JOIN (SELECT x.n, sum(CASE WHEN y.n = 0 THEN 1 ELSE 0.02 END * pow(0.98, x.n - y.n) * y.value) AS e FROM n x JOIN n y ON y.n BETWEEN x.n - 1500 AND x.n GROUP BY x.n) a USING (n)"
)
def q59_ema_one_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value is not null").select("event_id", "value")
    out = tensor.best_so_far(tensor.ema(rows, "event_id", "value"), "event_id", "value")
    return out.select("event_id", (F.round("ema", 4) + 0.0).alias("ema"), "is_best")


@query(
    f"WITH {E_SQL}, x AS (SELECT i, j, exp(v - max(v) OVER (PARTITION BY i)) AS x FROM e), y AS (SELECT i, j, x / sum(x) OVER (PARTITION BY i) AS y FROM x) "
    f"SELECT i, j, {R.format('1000 * y * (CASE WHEN j < 16 THEN y ELSE 0 END - sum(CASE WHEN j < 16 THEN y * y ELSE 0 END) OVER (PARTITION BY i))')} AS v FROM y"
)
def q60_sliced_softmax_grad(spark: SparkSession, sf: str) -> DataFrame:
    """The gradient of half the squares of a softmax's first 16 columns: the others' entries come from the sum alone."""
    y = tensor.softmax(_e(spark, sf))
    g = tensor.slice_cols_grad(tensor.slice_cols(y, 0, 16), 0)
    return _rounded(tensor.scale_grad(tensor.softmax_grad(y, g), 1000.0))


@query()
def q61_bpe_train_all_words(spark: SparkSession, sf: str) -> DataFrame:
    """The first merges over every word of the documents, without a list at the driver."""
    made = bpe_train.train(corpus.word_counts(_docs(spark, sf)), 64)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "rank int, left int, right int, new_id int")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
